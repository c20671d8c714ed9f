"""Best-fit packing of token pieces into sequences, by linear grouping of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, replace_columns, values

END_ID = 2
#: Ids that a task gathers before it hands them on.
HELD_IDS = 2_000_000
_ENCODERS: dict = {}


def _encoders(path: str):
    """Two encoders of one vocabulary: the fast one for ordinary text, the plain one where a special token is spelled out.

    Both give the same ids on ordinary text (tested); they are opened once per Python worker.
    """
    if path not in _ENCODERS:
        import base64
        import os

        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        special = [t.content for t in plain.get_added_tokens_decoder().values()]
        _ENCODERS[path] = (plain, fast, special)
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    plain, fast, special = _encoders(path)
    if fast is None or any(s in text for s in special):
        ids = plain.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, END_ID], dtype="<u4")


def cut_points(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than the limit."""
    first = total % limit or min(limit, total)
    return [(0, first)] + [(s, limit) for s in range(first, total, limit)]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise every whole text (null: empty), end it with END_ID and cut what is longer than ``limit``.

    Returns per piece: key, piece, start, length, ids_crc32, ``ids`` if asked for; ``__row``, whose top bits are the
    number of the partition, and ``__nth``, the piece's number from 0 among the pieces of its length in that partition.
    """
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("__nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    ddl = "piece int, start long, length long, ids_crc32 long, __nth long" + (", ids array<int>" if with_ids else "")

    def batch_of(batch: pa.RecordBatch, at: list[int], out: dict[str, list]) -> pa.RecordBatch:
        places = pa.array(at, pa.int64())
        columns = [batch.column(0).take(places), batch.column(2).take(places)]
        columns += [pa.array(out[name], kind) for name, kind in fields if name != "ids"]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out["ids"]])]).astype("i4")
            flat = np.concatenate([np.empty(0, "i4"), *out["ids"]])
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names=["__key", "__row", *[name for name, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(int)
        for batch in batches:
            at, out, held = [], defaultdict(list), 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = token_ids(text, tokenizer)
                for k, (start, length) in enumerate(cut_points(len(ids), limit)):
                    part = ids[start : start + length]
                    at.append(i)
                    facts = (k, start, length, zlib.crc32(part.tobytes()), seen[length])
                    for name, x in zip(("piece", "start", "length", "ids_crc32", "__nth"), facts):
                        out[name].append(x)
                    seen[length] += 1
                    if with_ids:
                        out["ids"].append(part.astype("i4"))
                held += len(ids)
                if held >= HELD_IDS:
                    yield batch_of(batch, at, out)
                    at, out, held = [], defaultdict(list), 0
            yield batch_of(batch, at, out)

    kind = rows.schema["__key"].dataType.simpleString()
    done = rows.select("__key", "__text", "__row").mapInArrow(run, f"__key {kind}, __row long, {ddl}")
    return done.withColumnRenamed("__key", key)


@dataclass
class Bins:
    """``count`` sequences with the same content: (length, copies) in order, and the room left."""

    count: int
    room: int
    content: list[tuple[int, int]] = field(default_factory=list)

    def take(self, n: int) -> Bins:
        self.count -= n
        return Bins(n, self.room, list(self.content))

    def add(self, length: int, copies: int) -> None:
        if copies:
            self.content.append((length, copies))
            self.room -= length * copies


def configurations(sizes: list[int], demand: list[int], limit: int, rounds: int = 1500) -> list[tuple[float, tuple[int, ...]]]:
    """Few-size cutting stock by column generation: (how often, copies of each size). ``sizes`` are descending."""
    k, lengths, shortest = len(sizes), np.array(sizes), min(sizes)
    basis = np.diag([float(limit // s) for s in sizes])
    need = np.array(demand, float)
    x = need / np.diag(basis)
    for _ in range(rounds):
        try:
            price = np.linalg.solve(basis.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        best = np.zeros(limit + 1)
        pick = np.full(limit + 1, -1)
        for c in range(shortest, limit + 1):  # unbounded knapsack over the limit
            fit = int(np.searchsorted(-lengths, -c))  # sizes from here on are at most c
            worth = best[c - lengths[fit:]] + price[fit:]
            i = int(np.argmax(worth))
            best[c] = best[c - 1]
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], fit + i
        if best[limit] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), limit
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        way = np.linalg.solve(basis, column)
        up = way > 1e-9
        if not up.any():
            break
        steps = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(np.argmin(steps))
        x = np.maximum(x - steps[out] * way, 0)
        x[out] = steps[out]
        basis[:, out] = column
    return [(x[j], tuple(int(n) for n in basis[:, j])) for j in range(k)]


def plan_bins(histogram: dict[int, int], limit: int = 1024) -> list[Bins]:
    """The smallest of three plans: few groups, many groups, and none, where best fit alone places every length.

    Rounding costs about one group's share of the large pieces, so many groups win where large lengths prevail; none
    wins where small pieces fill all room anyway.
    """
    plans = [group_lengths(histogram, limit, g) for g in (32, 160, 0)]
    return min(plans, key=lambda bins: sum(b.count for b in bins))


def group_lengths(histogram: dict[int, int], limit: int, groups: int, small: float = 0.25) -> list[Bins]:
    """Pack a histogram of lengths (at most ``limit`` different ones, however many pieces) into few sequences.

    Large lengths are rounded up within groups of equal numbers of pieces; configurations of the few sizes are
    optimised; the actual lengths take the slots, largest first; what is left and the small ones go where they fit best.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and n < limit}
    bins: list[Bins] = []
    if histogram.get(limit):
        full = Bins(histogram[limit], limit)
        full.add(limit, 1)
        bins.append(full)
    large = sorted((n for n in left if n > small * limit), reverse=True)
    total = sum(left[n] for n in large)
    if total > groups > 0:
        group_of: dict[int, int] = {}
        seen = 0
        for n in large:
            group_of[n] = min(groups - 1, seen * groups // total)
            seen += left[n]
        used = sorted(set(group_of.values()))
        sizes = [max(n for n in large if group_of[n] == g) for g in used]
        stock = {g: [[n, left[n]] for n in large if group_of[n] == g] for g in used}
        demand = [sum(c for _, c in stock[g]) for g in used]
        for often, copies in configurations(sizes, demand, limit):
            parts = [Bins(int(often + 1e-6), limit)]
            for g, wanted in zip(used, copies, strict=True):
                for _ in range(wanted):
                    parts = _fill(parts, stock[g])
            bins += [b for b in parts if b.count]
        left = {n: c for n, c in left.items() if n not in group_of}
        for entries in stock.values():
            for n, c in entries:
                left[n] = left.get(n, 0) + c
    return best_fit(bins, left, limit)


def _fill(parts: list[Bins], stock: list[list[int]]) -> list[Bins]:
    """Give each sequence the next actual length of a group; runs split where the length changes."""
    out = []
    for b in parts:
        while b.count and stock and stock[0][1]:
            n, c = stock[0]
            piece = b.take(min(b.count, c))
            piece.add(n, 1)
            out.append(piece)
            stock[0][1] -= piece.count
            if not stock[0][1]:
                stock.append(stock.pop(0))
        if b.count:
            out.append(b)
    return out


def best_fit(bins: list[Bins], left: dict[int, int], limit: int) -> list[Bins]:
    """Best-fit decreasing over counts: the tightest room first, as many copies as it holds."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    for b in bins:
        by_room[b.room].append(b)
    for n in sorted(left, reverse=True):
        c = left[n]
        for room in sorted(r for r in by_room if r >= n):
            waiting = by_room.pop(room)
            while waiting and c:
                b = waiting.pop()
                copies = min(room // n, c)
                many = min(b.count, c // copies)
                part = b.take(many)
                part.add(n, copies)
                by_room[part.room].append(part)
                c -= many * copies
                if b.count:
                    waiting.append(b)
            if waiting:
                by_room[room] += waiting
            if not c:
                break
        while c:
            copies = min(limit // n, c)
            fresh = Bins(c // copies, limit)
            fresh.add(n, copies)
            by_room[fresh.room].append(fresh)
            c -= fresh.count * copies
    return [b for group in by_room.values() for b in group if b.count]


def runs(bins: list[Bins]) -> list[dict]:
    """The plan by length: pieces numbered low..high-1 of a length go to sequences from ``base``, ``each`` per sequence."""
    out, base, seen = [], 0, defaultdict(int)
    for b in bins:
        offset = 0
        for n, copies in b.content:
            low = seen[n]
            seen[n] += b.count * copies
            out.append({"length": n, "__low": low, "__high": seen[n], "__base": base, "__each": copies, "__at": offset})
            offset += n * copies
        base += b.count
    return out


def pack_pieces(parts: DataFrame, limit: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length``, ``__nth`` and ``__row``, which becomes ``doc_row``.

    Only the histogram of lengths (at most ``limit`` rows) comes to the driver, and only the plan (at most some
    thousand runs, bounded by limit squared) is broadcast by hint. A piece's number among all of its length is its number
    in its partition plus what earlier partitions hold, so pieces are neither sorted nor shuffled to be numbered,
    however many have one length. The counts by partition are a written table: Spark broadcasts it below its own size
    limit and shuffles both sides beyond.
    """
    parts = keep(replace_columns(parts, ["sequence_id", "offset", "doc_row"]), "pieces")
    part_of = F.shiftright("__row", 33)  # monotonically_increasing_id keeps the partition there
    by_part = parts.groupBy(part_of.alias("__part"), "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = by_part.select("__part", "length", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    held = keep(held, "piece-counts")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    plan = runs(plan_bins(counts, limit))
    ddl = "length bigint, __low bigint, __high bigint, __base bigint, __each bigint, __at bigint"
    cut = values(parts.sparkSession, plan, ddl)
    ranked = parts.withColumn("__part", part_of).join(held.drop("__n"), ["__part", "length"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__nth"))
    fits = (ranked["length"] == cut["length"]) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    step = F.col("__rank") - F.col("__low")
    return ranked.join(F.broadcast(cut), fits).select(
        *[ranked[c] for c in parts.columns if not c.startswith("__")],
        F.col("__row").alias("doc_row"),
        (F.col("__base") + F.floor(step / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__at") + step % F.col("__each") * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``limit`` tokens as the method finds.

    Returns per piece: key, piece, start, length, ids_crc32, ids (if asked for), doc_row, sequence_id, offset. ``doc_row``
    is one number per input row, so the pieces of rows with the same key can be told apart. Null texts are
    empty and give one piece, the end id alone; a null or repeated key is just carried; equal rows are packed each;
    very long texts are cut, not shortened; an empty table gives no rows; other columns are not carried.
    """
    return pack_pieces(pieces(docs, tokenizer, limit, with_ids, key, text), limit)


def sequences(packed: DataFrame, with_parts: bool = False) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids in order of offset. Needs ``ids``.

    ``with_parts`` adds ``parts``, an array with the other columns of every piece in that order. A group is one sequence
    of at most ``limit`` ids, so at most so many pieces. No pieces give no rows.
    """
    others = [c for c in packed.columns if c not in ("sequence_id", "offset", "ids")] if with_parts else []
    piece = F.struct("offset", *others, "ids")  # offsets differ within a sequence, so they alone decide the order
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")
    if not with_parts:
        return whole.select("sequence_id", ids)
    rest = F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("offset", *others)]))
    return whole.select("sequence_id", ids, rest.alias("parts"))


def piece_digest(whole: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per piece of sequences with ``parts``: its place, and ``ids_crc32`` of what the sequence holds there."""
    names = [f.name for f in whole.schema["parts"].dataType.elementType.fields if f.name != "ids_crc32"]
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema["parts"].dataType.elementType.fields}
    ddl = ", ".join(["sequence_id long", "ids_crc32 long", *[f"`{n}` {kinds[n]}" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, ids, parts = batch.columns
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
            first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype("i8")
            of, part = parts.value_parent_indices(), parts.flatten()
            low = first[of.to_numpy()] + part.field("offset").to_numpy()
            high = low + part.field("length").to_numpy()
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(low, high)]
            columns = [sequence.take(of), pa.array(crc, pa.int64()), *[part.field(n) for n in names]]
            yield pa.RecordBatch.from_arrays(columns, names=["sequence_id", "ids_crc32", *names])

    done = whole.select("sequence_id", "ids", "parts").mapInArrow(run, ddl)
    return done.select(key, "piece", "start", "length", "ids_crc32", "doc_row", "sequence_id", "offset")
