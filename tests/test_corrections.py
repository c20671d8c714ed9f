"""The changelog always folds to the batch answer, whatever the order of arrival."""

import random

import pytest
from helpers import WALK, frame, id_sets, named, random_events, spec
from pyspark.sql import functions as F

from seqspark import apply_changelog, diff_matches, invalidate, match
from seqspark.streaming.store import correct, current_matches


def portions(events, n):
    size = -(-len(events) // n)
    return [events[i : i + size] for i in range(0, len(events), size)]


def feed(spark, tmp_path, parts, s, **kw):
    store = str(tmp_path / "store")
    for i, part in enumerate(parts):
        correct(frame(spark, part), i, s, store, **kw)
    return store


def changes(spark, store):
    return spark.read.parquet(f"{store}/changes")


def test_walk(spark, tmp_path):
    """The worked correction example: inserts, then an update by the late b12."""
    events = named(WALK)
    s = spec("a b+ c", 10, mode="maximal_compact")
    store = feed(spark, tmp_path, [events[:12], events[12:18], events[18:19], events[19:]], s)
    log = [(r.revision, r.kind, tuple(r.event_ids)) for r in changes(spark, store).collect()]
    first = {(0, "insert", (a, 8, 10)) for a in (3, 4, 5, 6, 7)}
    assert first <= set(log)
    assert {m for r, k, m in log if r == 1 and k == "insert"} == {(15, 16, 20), (13, 14, 16, 20)}
    assert {m for r, k, m in log if r == 2} == {(15, 16, 19), (13, 14, 16, 19), (9, 11, 14, 16, 19)}
    assert [(k, m) for r, k, m in log if r == 3] == [("update", (9, 11, 12, 14, 16, 19))]
    assert id_sets(current_matches(spark, store, s)) == id_sets(match(frame(spark, events), s))


def test_walk_next_retracts(spark, tmp_path):
    events = named(WALK)
    s = spec("a b+ c", 10, policy="next", mode="maximal")
    store = feed(spark, tmp_path, [events[:18], events[18:19], events[19:]], s)
    gone = {tuple(r.event_ids) for r in changes(spark, store).filter("kind = 'delete'").collect()}
    assert gone == {(15, 16, 20), (13, 14, 16, 20)}
    assert len(id_sets(current_matches(spark, store, s))) == 8


CASES = [("a b+ c", "contiguous", "all"), ("a+ b+ c", "next", "maximal"), ("a b+ c", "any", "maximal_compact")]


@pytest.mark.parametrize("text,policy,mode", CASES)
def test_any_arrival_order(spark, tmp_path, text, policy, mode):
    events = random_events(4, n=90)
    arrived = events + events[:20]  # twenty events come twice
    random.Random(9).shuffle(arrived)
    s = spec(text, 7, policy=policy, mode=mode)
    store = feed(spark, tmp_path, portions(arrived, 2), s)
    assert id_sets(current_matches(spark, store, s)) == id_sets(match(frame(spark, events), s))


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    events = random_events(6, n=60)
    s = spec("a b+ c", 7, mode="maximal")
    parts = portions(events, 2)
    store = feed(spark, tmp_path, parts, s)
    before = sorted(map(str, changes(spark, store).collect()))
    correct(frame(spark, parts[1]), 1, s, store)
    assert sorted(map(str, changes(spark, store).collect())) == before


def test_without_correction_short_matches_stay(spark, tmp_path):
    events = named(WALK)
    s = spec("a b+ c", 10, mode="maximal_compact")
    store = feed(spark, tmp_path, [events[:19], events[19:]], s, with_correction=False)
    kinds = {r.kind for r in changes(spark, store).collect()}
    left = id_sets(current_matches(spark, store, s))
    assert kinds == {"insert"} and (9, 11, 14, 16, 19) in left and (9, 11, 12, 14, 16, 19) in left


def test_gate_puts_rejected_events_aside(spark, tmp_path):
    events = named(WALK)
    s = spec("a b c", 10)
    store = feed(spark, tmp_path, [events], s, gate=lambda b, n: (b.filter("event_id <> 12"), b.filter("event_id = 12")))
    assert spark.read.parquet(f"{store}/dropped").count() == 1
    assert all(12 not in m for m in id_sets(current_matches(spark, store, s)))


def rows(spark, *matches):
    data = [(0, m[0], m[-1], m[-1], len(m), list(m)) for m in matches]
    df = spark.createDataFrame(data, "key long, start_ts long, end_ts long, end_id long, n_events int, event_ids array<long>")
    return df.withColumn("match_id", F.xxhash64("event_ids"))


def test_pairing(spark):
    old = rows(spark, (1, 3, 9), (1, 5, 9), (2, 4, 9), (7, 8, 9), (1, 2, 10))
    new = rows(spark, (1, 3, 5, 9), (2, 4, 6, 9), (2, 4, 6, 7, 9), (1, 2, 10))
    log = diff_matches(old, new, ["key"])
    got = sorted((r.kind, tuple(r.event_ids)) for r in log.collect())
    # (1,3,9) and (1,5,9) both grew into (1,3,5,9): one is the update, the other goes
    assert [g[0] for g in got].count("update") == 2
    assert ("update", (2, 4, 6, 9)) in got and ("insert", (2, 4, 6, 7, 9)) in got
    assert ("delete", (7, 8, 9)) in got and len(got) == 5
    log = log.withColumn("revision", F.lit(1).cast("long"))
    assert id_sets(apply_changelog(old, log, ["key"])) == id_sets(new)


def test_invalidate(spark):
    old = rows(spark, (1, 2, 9), (1, 3, 9))
    new = rows(spark, (1, 2, 7))
    assert id_sets(invalidate(old, new, ["key"])) == {(1, 2, 9)}


def gone_by_pairs(old, new):
    """The definition of invalidate over all pairs."""
    out = set()
    for k, ids, end in old:
        for j, other, stop in old + new:
            n = min(len(ids), len(other)) - 1
            if k == j and ids[0] == other[0] and ids[:n] == other[:n] and stop < end:
                out.add((k, tuple(ids)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_invalidate_is_its_definition(spark, seed):
    """Many matches begin with one event; matches of one event, repeats in both tables and equal prefixes occur."""
    rng = random.Random(seed)

    def some(n):
        rows = set()
        for _ in range(n):
            size = rng.randint(1, 5)
            rows.add((rng.choice([1, 1, 1, 2]), tuple(sorted(rng.sample(range(9), size)))))
        return [(k, list(ids), ids[-1]) for k, ids in sorted(rows)]

    old, new = some(40), some(30)

    def table(rows):
        df = spark.createDataFrame(rows, "key int, event_ids array<long>, end_ts long")
        return df.select(
            "key", F.get("event_ids", F.lit(0)).alias("start_ts"), "end_ts", F.col("end_ts").alias("end_id"),
            F.size("event_ids").alias("n_events"), "event_ids", F.xxhash64("event_ids").alias("match_id"),
        )

    got = invalidate(table(old), table(new), ["key"])
    rows = [(r["key"], tuple(r["event_ids"])) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == gone_by_pairs(old, new) != set()
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
