"""Two-level running scans against plain loops, with chunks far smaller than the keys."""

import pytest
from helpers import frame, random_events
from pyspark.sql import functions as F

from seqspark import next_event, prev_event, window_join
from seqspark.plans.scans import row_numbers, running


@pytest.fixture(scope="module")
def data(spark):
    events = random_events(11, n=200)
    return events, frame(spark, events).cache()


def test_running_values(data):
    events, df = data
    value = F.col("event_id")
    measures = {"s": ("sum", value, True), "s2": ("sum", value, False), "m": ("max", value, False)}
    got = {r.event_id: r for r in running(df, ["key"], "ts", 3, measures).collect()}
    assert len(got) == len(events)
    for e in events:
        mine = [x for x in events if x["key"] == e["key"]]
        before = [x["id"] for x in mine if x["t"] < e["t"]]
        upto = [x["id"] for x in mine if x["t"] <= e["t"]]
        r = got[e["id"]]
        assert (r.s or 0, r.s2, r.m) == (sum(before), sum(upto), max(upto))


def test_running_without_keys_and_backwards(data):
    events, df = data
    got = running(df, [], "ts", 5, {"m": ("min", F.col("event_id"), True)}, reverse=True).collect()
    for r in got:
        later = [x["id"] for x in events if x["t"] > r.ts]
        assert r.m == (min(later) if later else None)


def test_neighbours(data):
    events, df = data
    out = next_event(df, "kind = 'b'", ["key"], chunk=2, payload=("event_id",))
    out = prev_event(out, "kind = 'c'", ["key"], chunk=2, payload=("event_id", "ts"))
    for r in out.collect():
        mine = [x for x in events if x["key"] == r.key]
        later = [(x["t"], x["id"]) for x in mine if x["kind"] == "b" and x["t"] > r.ts]
        earlier = [(x["t"], x["id"]) for x in mine if x["kind"] == "c" and x["t"] <= r.ts]
        assert (r.next.event_id if r.next else None) == (min(later)[1] if later else None)
        assert (r.prev.event_id if r.prev else None) == (max(earlier)[1] if earlier else None)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, 5)], "event_id long, ts long, key long")
    out = running(df, ["key"], "ts", 1, {"n": ("sum", F.lit(1), True)})
    assert {r.event_id: r.n for r in out.collect()} == {1: None, 2: 1, 3: None}


def test_row_numbers(data):
    events, df = data
    got = {r.event_id: r.n for r in row_numbers(df, "ts", "event_id", 4, "n").collect()}
    ordered = sorted(events, key=lambda e: (e["t"], e["id"]))
    assert got == {e["id"]: i + 1 for i, e in enumerate(ordered)}


@pytest.mark.parametrize("salt", [1, 5])
def test_window_join(data, salt):
    events, df = data
    left, right = df.filter("kind = 'a'"), df.filter("kind = 'b'")
    out = window_join(left, right, 4, ["key"], salt=salt)
    got = [(r.l_event_id, r.r_event_id) for r in out.collect()]
    want = [
        (x["id"], y["id"]) for x in events for y in events
        if x["kind"] == "a" and y["kind"] == "b" and x["key"] == y["key"] and x["t"] < y["t"] <= x["t"] + 4
    ]
    assert sorted(got) == sorted(want)


def test_disturbances(spark):
    from seqspark import dedup_events, inject_delay, inject_disorder, inject_duplicates

    n = 20_000
    df = spark.range(n).selectExpr("id AS event_id", "id AS ts", "id % 7 AS kind")
    moved = inject_disorder(df, 0.2, seed=1).cache()
    share = moved.filter("out_of_order").count() / n
    assert 0.18 < share < 0.22
    assert moved.agg(F.countDistinct("arrival_seq"), F.max("arrival_seq")).first()[:] == (n, n)
    late = moved.filter("arrival_seq - 1 > event_id + 30").count() / n
    assert 0 < late < 0.01
    again = inject_duplicates(df, 0.3, seed=2)
    assert 1.27 < again.count() / n < 1.33
    assert dedup_events(again.withColumn("arrival_seq", F.col("event_id") * 2 + F.col("copy")), ("event_id",)).count() == n
    lag = inject_delay(df, 0.5, 3, 9, seed=4).selectExpr("ingest_ts - ts AS d")
    counts = {r.d: r["count"] / n for r in lag.groupBy("d").count().collect()}
    assert set(counts) == {0, *range(3, 10)}
    assert all(0.06 < counts[d] < 0.082 for d in range(3, 10))


def test_three_levels_equal_two(data):
    events, df = data
    for reverse in (False, True):
        measures = {"s": ("sum", F.col("event_id"), True), "m": ("max", F.col("event_id"), False)}
        two, three = (
            {tuple(r) for r in running(df, ["key"], "ts", 1, measures, reverse=reverse, levels=n).collect()}
            for n in (2, 3)
        )
        assert two == three and len(two) == len(events)


def test_busy_key_is_cut_into_even_tasks(spark):
    """One key holds a third of all rows; cut to the data, no task group gets far above the limit."""
    from helpers import spec

    from seqspark import count_matches, fit_to_data
    from seqspark.functions import bucket_of

    n, limit = 60_000, 500
    df = spark.range(n).selectExpr(
        "id AS event_id", "id div 3 AS ts", "substring('abc', int(id % 7 % 3) + 1, 1) AS kind",
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 1000 END AS key",
    )
    s = spec("a b c", 2000)
    cut = fit_to_data(df, s, limit)
    assert cut.salt >= 3 and cut.chunk <= 2000 // 3
    sizes = df.groupBy("key", bucket_of(F.col("ts"), cut.chunk).alias("k")).count()
    assert sizes.agg(F.max("count")).first()[0] <= limit * 1.5
    assert count_matches(df, s).first() == count_matches(df, cut).first()
    assert fit_to_data(df, spec("a b", 5), limit).salt == 1
