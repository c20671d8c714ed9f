"""Repair of the role structure of conversations: run-length min-plus dynamic program in mergeable segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep

SEGMENT = 4096  # rows that one step of the chain stands for, at most
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT is added for a truncated row that stays
FAR = 1 << 60

# states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# a row's symbol is 2 * role + truncated for the roles s, u, a, other; rows that must go are all one symbol
ROLES = "sua"
DEAD = 8
Vector = tuple[int, int, int, int]
ENDS: Vector = (0, 2 * INSERT, INSERT, 0)  # cheapest way to end legally: by inserted turns


def _moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: (edit, cost, next state); K keep, U/A new role user/assistant, D delete."""
    moves = [("D", DELETE, state)]
    if symbol != DEAD:
        role, cut = symbol // 2, CUT * (symbol % 2)
        turn = NEXT_INSERT[state]
        moves.append(("U" if turn == USER else "A", REROLE + cut, turn))
        if role == 0 and state == START:
            moves.append(("K", KEEP + cut, SYSTEM))
        elif role in (1, 2) and turn == (USER if role == 1 else ASSISTANT):
            moves.append(("K", KEEP + cut, turn))
    return moves


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two 4 x 4 matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def reach(a: tuple, v: Vector) -> Vector:
    """Costs before the rows of ``a`` from costs ``v`` after them."""
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


NONE = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> tuple:
    """Transition of 2^bit rows of one symbol, with insertions before each."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    out = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        state, paid = i, 0
        for _ in range(4):
            for _, cost, after in _moves(state, symbol):
                out[i][after] = min(out[i][after], paid + cost)
            state, paid = NEXT_INSERT[state], paid + INSERT
    return tuple(map(tuple, out))


def bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def run_matrix(symbol: int, n: int) -> tuple:
    out = NONE
    for k in bits(n):
        out = times(out, power(symbol, k))
    return out


def before_run(symbol: int, n: int, v: Vector) -> Vector:
    for k in bits(n):
        v = reach(power(symbol, k), v)
    return v


@lru_cache(maxsize=1 << 16)
def step_back(symbol: int, v: Vector) -> tuple[Vector, int]:
    """Costs before one row, with their least taken out: only differences decide."""
    w = reach(power(symbol, 0), v)
    low = min(w)
    return tuple(x - low for x in w), low


@lru_cache(maxsize=1 << 16)
def choose(state: int, symbol: int, after: Vector) -> tuple[str, int]:
    """The edits of one row and the state after it: cheapest, then ASCII-least by D, I, K, R."""
    done = ""
    while True:
        here = reach(power(symbol, 0), after)[state]
        rows = {e: s for e, c, s in _moves(state, symbol) if c + after[s] == here}
        turn = NEXT_INSERT[state]
        if "D" in rows:
            return done + "D", rows["D"]
        if INSERT + reach(power(symbol, 0), after)[turn] == here:
            done, state = done + ("u" if turn == USER else "a"), turn
            continue
        edit = "K" if "K" in rows else next(iter(rows))
        return done + edit, rows[edit]


AUDIT = str.maketrans("UAua", "RRII")


def runs_of(symbols: list[int], counts: list[int], firsts: list[bool]) -> list[tuple[int, int]]:
    """Equal neighbours collapsed: a group of n equal rows is its first row, if that stays, and rows that must go."""
    flat = []
    for s, n, f in zip(symbols, counts, firsts):
        if f:
            flat.append((s, 1))
            n -= 1
        if n:
            flat.append((DEAD, n))
    return [(s, sum(n for _, n in g)) for s, g in groupby(flat, key=lambda x: x[0])]


def segment_matrix(runs: list[tuple[int, int]]) -> tuple:
    out = NONE
    for s, n in runs:
        out = times(out, run_matrix(s, n))
    return out


def walk(runs: list[tuple[int, int]], after: Vector, state: int, last: bool) -> tuple[list[tuple[str, int]], str, int]:
    """Unroll the choices of a segment: edits as (edits, repeats) in order, the inserts that end it, the state reached.

    Costs behind every run come from powers; inside a run of rows that may stay they are stepped back row by row. Rows
    that must go are deleted at once: a deletion is the least letter and costs the same before and after an insertion.
    """
    behind = [after]
    for s, n in reversed(runs):
        v = before_run(s, n, behind[-1])
        behind.append(tuple(x - min(v) for x in v))
    behind.reverse()
    edits: list[tuple[str, int]] = []
    for (s, n), v in zip(runs, behind[1:]):
        if s == DEAD:
            edits.append(("D", n))
            continue
        inner = [v]
        for _ in range(n - 1):
            inner.append(step_back(s, inner[-1])[0])
        for v in reversed(inner):
            e, state = choose(state, s, v)
            edits.append((e, 1))
    end = ""
    while last and state in (SYSTEM, USER):
        state = NEXT_INSERT[state]
        end += "u" if state == USER else "a"
    return edits, end, state


class Repair(NamedTuple):
    facts: DataFrame
    turns: DataFrame


ROWS = "nt boolean, tv long, role string, h binary, symbol int, n long, is_first boolean"
SEGMENTS = (
    "ck string, block long, seg long, rows array<struct<nt:boolean,tv:long,role:string,h:binary,symbol:int,n:long,is_first:boolean>>, matrix array<long>, "
    "illegal long, head string, tail string, low long, top long, turns long"
)
CHAIN = "ck string, block long, seg long, after array<long>, leads boolean, ends boolean, illegal long, gaps long, cost long"
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _row_type() -> pa.DataType:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.struct([(c, kinds[k]) for c, k in (x.split() for x in ROWS.split(", "))])


SEGMENT_SCHEMA = pa.schema(
    [("ck", pa.string()), ("block", pa.int64()), ("seg", pa.int64()), ("rows", pa.list_(_row_type())), ("matrix", pa.list_(pa.int64())), ("illegal", pa.int64())]
    + [("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("top", pa.int64()), ("turns", pa.int64())]
)
LEGAL = ("su", "ua", "au")


def _segment(ck: str, block: int, seg: int, rows: list[dict]) -> dict:
    runs = runs_of([r["symbol"] for r in rows], [r["n"] for r in rows], [r["is_first"] for r in rows])
    heads = [r["role"][:1] for r in rows]
    illegal = sum(n - 1 for n in (r["n"] for r in rows)) + sum(a + b not in LEGAL for a, b in zip(heads, heads[1:]))
    turns = [r["tv"] for r in rows if r["nt"]]
    return {
        "ck": ck, "block": block, "seg": seg, "rows": rows, "matrix": [x for line in segment_matrix(runs) for x in line], "illegal": illegal, "head": heads[0],
        "tail": heads[-1], "low": turns[0] if turns else None, "top": turns[-1] if turns else None, "turns": sum(1 for _ in groupby(turns)),
    }


def _cut(batches: Iterator[pa.RecordBatch], size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments of one conversation; they are numbered by the range partition and their place in it."""
    block, seg, ck, held = TaskContext.get().partitionId(), 0, None, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and (r["ck"] != ck or len(held) == size):
                out.append(_segment(ck, block, seg, held))
                seg, held = seg + 1, []
            ck = r.pop("ck")
            held.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SEGMENT_SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist([_segment(ck, block, seg, held)], schema=SEGMENT_SCHEMA)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind every segment of a conversation, from its segments' matrices; facts stand on the first segment."""
    schema = pa.schema(
        [("ck", pa.string()), ("block", pa.int64()), ("seg", pa.int64()), ("after", pa.list_(pa.int64())), ("leads", pa.bool_()), ("ends", pa.bool_())]
        + [(c, pa.int64()) for c in ("illegal", "gaps", "cost")]
    )
    for batch in batches:
        out = []
        for conversation in batch.to_pylist():
            v, paid, rows, segs = ENDS, 0, [], conversation["segs"]
            for s in reversed(segs):
                rows.append({"ck": conversation["ck"], "block": s["block"], "seg": s["seg"], "after": list(v), "leads": False, "ends": s is segs[-1]})
                m = [s["matrix"][4 * i : 4 * i + 4] for i in range(4)]
                v = reach(m, v)
                paid, v = paid + min(v), tuple(x - min(v) for x in v)
            illegal = sum(s["illegal"] for s in segs) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(segs, segs[1:]))
            some = [s for s in segs if s["turns"]]
            distinct = sum(s["turns"] for s in some) - sum(a["top"] == b["low"] for a, b in zip(some, some[1:]))
            gaps = some[-1]["top"] - some[0]["low"] + 1 - distinct if some else 0
            rows[-1] |= {"leads": True, "illegal": illegal, "gaps": gaps, "cost": paid + v[START]}
            out += rows
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _solved(r: dict) -> tuple[list[tuple[int, int]], Vector]:
    runs = runs_of([x["symbol"] for x in r["rows"]], [x["n"] for x in r["rows"]], [x["is_first"] for x in r["rows"]])
    return runs, tuple(r["after"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which state a segment is left in, for each state it may be entered in."""
    for batch in batches:
        rows = batch.to_pylist()
        exits = [[walk(*_solved(r), s, False)[2] for s in range(4)] for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.select(["ck", "block", "seg"]).columns, pa.array(exits, pa.list_(pa.int32()))], names=["ck", "block", "seg", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ck", pa.string()), ("block", pa.int64()), ("seg", pa.int64()), ("entry", pa.int32())])
    for batch in batches:
        out = []
        for c in batch.to_pylist():
            state = START
            for s in c["segs"]:
                out.append({"ck": c["ck"], "block": s["block"], "seg": s["seg"], "entry": state})
                state = s["exits"][state]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


DECISIONS = "ck string, nt boolean, tv long, role string, h binary, block long, seg long, pos long, edits string, audit string"


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group of equal rows the edits of its first row; the segment's part of the audit stands on its first row."""
    names = [x.split()[0] for x in DECISIONS.split(", ")]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs, after = _solved(r)
            edits, end, _ = walk(runs, after, r["entry"], r["ends"])
            stays = _of_first_rows(runs, edits)
            audit = "".join(e * n for e, n in edits) + end
            for pos, x in enumerate(r["rows"]):
                own = next(stays) if x["is_first"] and x["symbol"] != DEAD else ""
                if pos == len(r["rows"]) - 1:
                    own += end
                row = {"ck": r["ck"], **{c: x[c] for c in ("nt", "tv", "role", "h")}, "block": r["block"], "seg": r["seg"], "pos": pos, "edits": own}
                out.append(row | {"audit": audit.translate(AUDIT) if pos == 0 else None})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _of_first_rows(runs: list[tuple[int, int]], edits: list[tuple[str, int]]) -> Iterator[str]:
    """The edits of the rows that may stay, in order: those of runs that are not of rows that must go."""
    at = 0
    for s, n in runs:
        if s == DEAD:
            at += 1
        else:
            yield from (e for e, _ in edits[at : at + n])
            at += n


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    own = df.select(
        F.concat_ws(":", F.lit("c"), F.col(conv).cast("string")).alias("ck"), F.col(conv).alias("conv"), F.col(turn).isNotNull().alias("nt"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("tv"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return own.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> Repair:
    """Cheapest edits that give every conversation the role order ``(system? (user assistant)+)?``.

    A conversation's rows stand in order of turn (nulls first); rows of one turn in order of role and of a hash of
    their text, equal rows side by side. A row's first fault counts: blank (no character but white space), duplicate
    (role and text seen earlier), truncated (its last other character is none of ``.!?``). Edits: keep 0, new role 1,
    delete 2 (required for blank and duplicate rows), insert an empty turn 5; a truncated row that stays costs 5 more.
    Of the cheapest edit lists the ASCII-least by the letters D, I, K, R is taken.

    Returns ``facts``, one row per conversation (the id, gaps, blank, duplicate, truncated, illegal, cost, audit), and
    ``turns``, the repaired rows (id, place, edit, role, text; sort by place). Null ids are one conversation, a null
    role or text is one space, an empty role has no legal initial; all turns null gives no gaps; repeated rows are
    counted each; other columns are not carried; an empty table gives none.

    A conversation may hold any share of all rows. Equal rows are counted before they are shuffled, first occurrences
    come from a combined minimum, rows are ranged over all partitions by (conversation, place), and segments of at
    most ``segment`` rows are reduced to one 4 x 4 min-plus matrix: run-length symbols advance by cached binary powers.
    One task per conversation sees only these matrices (one for 4,096 rows), forwards and backwards; choices are then
    unrolled in every segment alone. The audit of a conversation is one value of the result.
    """
    rows = _rows(df, conv, turn, role, text)
    trimmed = F.rtrim("text", F.lit(SPACES))
    state = rows.select(
        "ck", "nt", "tv", "role", "h", (F.length(trimmed) == 0).alias("is_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("is_cut")
    )
    groups = state.groupBy("ck", "nt", "tv", "role", "h", "is_blank", "is_cut").agg(F.count("*").alias("n"))
    first = groups.groupBy("ck", "role", "h").agg(F.min(F.struct("nt", "tv")).alias("first"))
    marked = groups.join(first, ["ck", "role", "h"]).withColumn("is_first", (F.col("first.nt") == F.col("nt")) & (F.col("first.tv") == F.col("tv")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    stays = F.col("is_first") & ~F.col("is_blank")
    symbol = F.when(stays, kind * 2 + F.col("is_cut").cast("int")).otherwise(DEAD).cast("int")
    marked = keep(marked.select("ck", "nt", "tv", "role", "h", symbol.alias("symbol"), "n", stays.alias("is_first"), "is_blank", "is_cut"), "turn-groups")

    place = ["ck", "nt", "tv", "role", "h"]
    ordered = marked.select(*place, "symbol", "n", "is_first").repartitionByRange(*place).sortWithinPartitions(*place)
    segs = keep(ordered.mapInArrow(partial(_cut, size=segment), SEGMENTS), "turn-segments")
    light = F.struct("block", "seg", "matrix", "illegal", "head", "tail", "low", "top", "turns")
    chain = segs.groupBy("ck").agg(F.array_sort(F.collect_list(light)).alias("segs")).mapInArrow(_chain, CHAIN)
    chain = keep(chain, "turn-chain")
    solved = segs.select("ck", "block", "seg", "rows").join(chain.select("ck", "block", "seg", "after", "leads", "ends"), ["ck", "block", "seg"])
    several = solved.where(~(F.col("leads") & F.col("ends"))).select("ck", "block", "seg", "rows", "after").mapInArrow(_exits, "ck string, block long, seg long, exits array<int>")
    entries = several.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("block", "seg", "exits"))).alias("segs"))
    entries = entries.mapInArrow(_entries, "ck string, block long, seg long, entry int")
    entered = solved.join(entries, ["ck", "block", "seg"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    decisions = keep(entered.select("ck", "block", "seg", "rows", "after", "ends", "entry").mapInArrow(_unroll, DECISIONS), "turn-edits")

    n = F.col("n")
    faults = marked.groupBy("ck").agg(
        F.sum(F.when(F.col("is_blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("is_blank"), 0).otherwise(n - F.col("is_first").cast("long"))).alias("duplicate"),
        F.sum((F.col("is_first") & F.col("is_cut")).cast("long")).alias("truncated"),
    )
    parts = decisions.where("audit is not null").groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("block", "seg", "audit"))).alias("a"))
    audits = parts.select("ck", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    ids = rows.groupBy("ck").agg(F.max("conv").alias(conv))
    facts = ids.join(faults, "ck").join(chain.where("leads").select("ck", "illegal", "gaps", "cost"), "ck").join(audits, "ck")
    facts = facts.select(conv, *FACTS, "audit")

    texts = rows.groupBy(*place).agg(F.max("text").alias("text"), F.max("conv").alias(conv))
    left = decisions.where("edits <> ''").select(*place, "block", "seg", "pos", F.posexplode(F.split("edits", "")).alias("k", "edit")).where("edit not in ('', 'D')")
    turns = left.join(texts, place)
    inserted = F.col("edit").isin("u", "a")
    new_role = F.when(F.col("edit") == "K", F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
    turns = turns.select(
        conv, F.struct("block", "seg", "pos", "k").alias("place"), F.translate("edit", "UAua", "RRII").alias("edit"), new_role.alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
    )
    return Repair(facts, turns)


def transcript_hashes(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines, joined by newlines: (ck, repaired_sha256).

    The hash reads its bytes in order, so the lines of a conversation pass one task, one after the other and sorted by
    Spark; the task holds a running hash, never the conversation.
    """
    lines = turns.select(F.concat_ws(":", F.lit("c"), F.col(conv).cast("string")).alias("ck"), "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("ck").sortWithinPartitions("ck", "place").select("ck", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, running = None, hashlib.sha256()
        for batch in batches:
            out = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == ck:
                    running.update(b"\n")
                else:
                    if ck is not None:
                        out.append((ck, running.hexdigest()))
                    ck, running = key, hashlib.sha256()
                running.update(line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["ck", "repaired_sha256"])
        if ck is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ck]), pa.array([running.hexdigest()])], names=["ck", "repaired_sha256"])

    return lines.mapInArrow(run, "ck string, repaired_sha256 string")


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Planted faults by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes the marks
    ``.!?``, 3 repeats it, 4 makes its role user; a null in the key, role or text is one space."""
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    given = F.coalesce(F.col(text), F.lit(" "))
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(given, ".!?", "")).otherwise(given)
    new_role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))
    times_ = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = df.select(F.col(conv), F.col(turn), new_role.alias(role), new_text.alias(text), F.explode(F.array_repeat(F.lit(0), times_)).alias("__copy"))
    return rows.drop("__copy")


def repair_report(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """Facts of every conversation of ``df`` after planted damage and repair, with the hash of the repaired lines.

    Conversations of which no row is left have zeros, an empty audit and the hash of the empty string.
    """
    repair = repair_conversations(damaged(df, conv, turn, role, text), conv, turn, role, text, segment)
    key: Column = F.concat_ws(":", F.lit("c"), F.col(conv).cast("string"))
    ids = df.select(F.col(conv)).groupBy(conv).count().select(conv, key.alias("ck"))
    facts = repair.facts.withColumn("ck", key).drop(conv)
    out = ids.join(facts, "ck", "left").join(transcript_hashes(repair.turns, conv), "ck", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        conv, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FACTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
