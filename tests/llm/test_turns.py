import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from seqspark.llm.turns import FACTS, repair_conversations, repair_report

DDL = "conv_id long, turn int, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def one_space(x):
    return " " if x is None else x


def damage(rows):
    out = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{one_space(c)}:{one_space(t)}".encode()) % 20
        r, x = one_space(r), one_space(x)
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        out += [(c, t, "user" if d == 4 else r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def brute(rows, ids):
    """Every edit list is weighed from the end of a conversation: (cost, audit, lines) per state, no runs, no powers."""
    convs = {c: [] for c in ids}
    for c, t, r, x in rows:
        convs[c].append((t, one_space(r), one_space(x)))
    out = {}
    turn_after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for c, rs in convs.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.sha256(z[2].encode()).digest()))
        seen, faults = set(), []
        for _, r, x in rs:
            y = x.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
            seen.add((r, x))

        def closed(best):
            """Insertions before what follows."""
            out = {}
            for s in turn_after:
                some, at, n, lines = [], s, 0, ()
                while n < 4:
                    if best[at]:
                        k, a, ls = best[at]
                        some.append((5 * n + k, "I" * n + a, lines + ls))
                    role = turn_after[at]
                    at, n, lines = role[0], n + 1, lines + (role + ":",)
                out[s] = min(some, key=lambda z: z[:2])
            return out

        best = closed({"": (0, "", ()), "s": None, "u": None, "a": (0, "", ())})
        for (_, r, x), f in reversed(list(zip(rs, faults))):
            step = {}
            for s in turn_after:
                some = [(2 + best[s][0], "D" + best[s][1], best[s][2])]
                if f not in ("blank", "duplicate"):
                    for role, letter, cost in (("user", "R", 1), ("assistant", "R", 1), (r, "K", 0)):
                        h = role[:1]
                        if h == turn_after[s][0] or (letter == "K" and h == "s" and s == ""):
                            k, a, ls = best[h]
                            some.append((cost + 5 * (f == "truncated") + k, letter + a, (f"{role}:{x}",) + ls))
                step[s] = min(some, key=lambda z: z[:2])
            best = closed(step)
        ts = [t for t, _, _ in rs if t is not None]
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        cost, audit, lines = best[""]
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["a.", "b.", "c", "d!", "", "  \n", "e. ", "f?", "g", "h.", None, "é " * 4000 + "."] + [f"x{i}." for i in range(10)]
    out = []
    for c in [None, *range(60)]:
        for _ in range(rng.choice([1, 3, 10, 30])):
            out.append((c, rng.choice([None, *range(9), *range(20, 32)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    out += [(99, 5, "user", "same.")] * 50 + [(98, None, "user", "same.")] * 5
    out += [(100, i, "assistant" if i % 2 else "user", f"t{i}." + ("x" if rng.random() < 0.1 else "")) for i in range(300)]
    out += [(101, i, "user", f"t{i}.") for i in range(40)]  # one long run
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "gone.")]


def report(df, segment):
    found = repair_report(df, segment=segment).select("conv_id", *FACTS, "audit", "repaired_sha256").collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("segment", [4096, 3])
def test_report_equals_brute_force(spark, rows, segment):
    df = spark.createDataFrame(rows, DDL).repartition(4)
    want = brute(damage(rows), {r[0] for r in rows})
    assert report(df, segment) == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", EMPTY) for v in want.values())


def test_repaired_turns_are_legal(spark, rows):
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "'clash' AS ck", "1 AS edits", "'x' AS block")
    repair = repair_conversations(df)
    lines = defaultdict(list)
    for r in sorted(repair.turns.collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append((r["role"], r["edit"]))
    facts = repair.facts.collect()
    assert {r["conv_id"] for r in facts} == {r[0] for r in rows}
    for r in facts:
        own = lines.get(r["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in own))
        assert [e for _, e in own] == [e for e in r["audit"] if e != "D"]


def test_no_rows(spark):
    none = spark.createDataFrame([], DDL)
    assert repair_report(none).collect() == []
    assert repair_conversations(none).turns.collect() == []
