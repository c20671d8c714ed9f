"""Live queries over files: restart, late events, equality with the batch answer."""

import datetime as dt
import shutil
from pathlib import Path

import pytest
from helpers import id_sets, random_events, spec
from pyspark.sql import functions as F

from seqspark import PatternSpec, Step, adaptive_threshold, apply_changelog, classify_lateness, lateness_score, match
from seqspark.operators.near import slim
from seqspark.sources import write_changelog
from seqspark.streaming import LatenessGate, compact, correct, current_matches, live_matches, snapshots, stream_dropped, stream_match, stream_match_batch
from seqspark.streaming import store as streaming_store
from seqspark.streaming.snapshots import numbered

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, kind string, key long"


def timed(spark, events):
    rows = [(e["id"], BASE + dt.timedelta(minutes=e["t"]), e["kind"], e["key"]) for e in events]
    return spark.createDataFrame(rows, SCHEMA)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def test_store_survives_restart(spark, tmp_path):
    events = random_events(8, n=60)
    s = spec("a b+ c", "7 min", mode="maximal")
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    for part in (events[::2], events[1::2]):
        timed(spark, part).coalesce(1).write.mode("append").parquet(str(inbox))
        stream_match_batch(source(spark, inbox), s, store, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{store}/events").select("revision").distinct().count() == 2
    assert id_sets(current_matches(spark, store, s)) == id_sets(match(timed(spark, events), s))


@pytest.mark.parametrize("text,policy,mode", [("a+ b+ c", "any", "maximal"), ("a b+ c", "next", "maximal")])
def test_keyed_state_survives_restart(spark, tmp_path, text, policy, mode):
    events = random_events(8, n=100, keys=1, kinds="abc")
    s = spec(text, "7 min", policy=policy, mode=mode)
    inbox = tmp_path / "in"

    def keep(batch, number):
        write_changelog(batch, str(tmp_path / "log"), number)

    for part in (events[::2], events[1::2]):
        timed(spark, part).coalesce(1).write.mode("append").parquet(str(inbox))
        log = stream_match(source(spark, inbox), s, delay="2 hours")
        job = log.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
        job.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    got = id_sets(apply_changelog(None, log, ["key"]))
    assert got == id_sets(match(timed(spark, events), s))
    assert {r.kind for r in log.select("kind").distinct().collect()} > {"insert"}


def test_keys_share_the_state_of_their_slot(spark, tmp_path):
    events = random_events(8, n=120, keys=30, kinds="abc")
    s, held = spec("a b c", "30 min"), {}
    df = timed(spark, events).withColumn("key", F.concat(F.lit('k,"'), "key"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for slots in (2, 1000):
        log = stream_match(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), s, delay="2 hours", slots=slots)
        job = log.writeStream.foreachBatch(lambda b, n: write_changelog(b, str(tmp_path / f"log{slots}"), n))
        job = job.option("checkpointLocation", str(tmp_path / f"cp{slots}")).trigger(availableNow=True).start()
        job.awaitTermination()
        held[slots] = job.recentProgress[0]["stateOperators"][0]["numRowsUpdated"]
        got = apply_changelog(None, spark.read.parquet(str(tmp_path / f"log{slots}")), ["key"])
        want = match(df, s)
        assert got.select("key", "event_ids").exceptAll(want.select("key", "event_ids")).count() == 0
        assert id_sets(got) == id_sets(want) and want.count() > 10
    assert held[2] * 3 < held[1000]


@pytest.mark.parametrize("policy,copies", [("any", 1), ("next", 2)])
def test_ends_go_to_a_second_bucket_only_where_they_count_there(spark, tmp_path, policy, copies):
    events = [{"id": i, "t": 1, "kind": "c", "key": 0} for i in range(3)]
    timed(spark, events).coalesce(1).write.parquet(str(tmp_path / "in"))
    log = stream_match(source(spark, tmp_path / "in"), spec("a b c", "30 min", policy=policy), delay="2 hours")
    job = log.writeStream.foreachBatch(lambda b, n: b.collect()).option("checkpointLocation", str(tmp_path / "cp"))
    job = job.trigger(availableNow=True).start()
    job.awaitTermination()
    assert job.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] == copies


def test_dropped_rows_are_those_the_watermark_leaves_out(spark, tmp_path):
    events = random_events(9, n=90, keys=1, kinds="abc")
    s, inbox = spec("a b c", "7 min"), tmp_path / "in"
    late = events[::6]
    for k, part in enumerate((([e for e in events if e not in late])[:50], late[:8], [e for e in events if e not in late][50:] + late[8:])):
        timed(spark, part).coalesce(1).write.mode("append").parquet(str(inbox))
        stream_dropped(source(spark, inbox), str(tmp_path / "side"), str(tmp_path / "cp1"), "10 minutes").awaitTermination()
        log = stream_match(source(spark, inbox), s, delay="10 minutes")
        job = log.writeStream.foreachBatch(lambda b, n: write_changelog(b, str(tmp_path / "log"), n)).option("checkpointLocation", str(tmp_path / "cp"))
        job.trigger(availableNow=True).start().awaitTermination()
    lost = {r.event_id for r in spark.read.parquet(str(tmp_path / "side" / "late")).collect()}
    assert lost
    kept = [e for e in events if e["id"] not in lost]
    got = id_sets(apply_changelog(None, spark.read.parquet(str(tmp_path / "log")), ["key"]))
    assert got == id_sets(match(timed(spark, kept), s))


@pytest.mark.parametrize("factor", [0.5, 1.0, 1.5])
def test_gate_decides_alike_for_any_cut_into_batches(spark, tmp_path, factor):
    events = random_events(4, n=80, keys=2, kinds="ab")
    rows = [(e["id"], (e["t"] * 7919) % 97, e["kind"], e["key"], i) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, ts long, event_type string, source long, arrival_seq long").persist()
    sources = spark.createDataFrame([("a", 3), ("b", 9)], "event_type string, est_interval_ms long")
    late = classify_lateness(df, sources, chunk=10)
    whole = adaptive_threshold(lateness_score(late, 50), factor, chunk=10)
    want = {r.event_id: r.accepted for r in whole.collect()}
    for cuts in ((0, 80), (0, 1, 2, 40, 80), (0, 13, 26, 80)):
        gate = LatenessGate(sources, 50, str(tmp_path / str(len(cuts))), factor, chunk=10)
        got = {}
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            part = df.where((df.arrival_seq >= lo) & (df.arrival_seq < hi))
            for _ in range(2):  # a repeated batch decides the same
                kept, dropped = gate(part, n)
                got |= {r.event_id: True for r in kept.collect()} | {r.event_id: False for r in dropped.collect()}
        assert got == want
    assert len(set(want.values())) == 2 or factor == 1.5


def test_keyed_state_refuses_what_it_cannot_do(spark, tmp_path):
    df = timed(spark, random_events(1, n=5))
    df.write.parquet(str(tmp_path / "in"))
    stream = source(spark, tmp_path / "in")
    for s in (
        spec("a b+ c", "7 min"),
        spec("a !n c", "7 min"),
        spec("a b c", "7 min", policy="contiguous"),
        spec("a+ b+ c", "7 min", policy="next", mode="maximal"),
    ):
        with pytest.raises(ValueError):
            stream_match(stream, s)


def files_of(store, kind):
    """Data files per bucket folder of the snapshots."""
    return {p.name: len(list(p.glob("*.parquet"))) for p in Path(store, "snapshots", kind).glob("gen=*/*=*")}


def deltas(spark, store, n, spec, events):
    """What a micro-batch leaves in the store, without matching it: its events, and one match per end."""
    width = 3_600_000_000
    df = timed(spark, events).withColumn("time_bucket", F.floor(F.unix_micros("ts") / width))
    df.write.partitionBy("time_bucket").parquet(f"{store}/events/revision={n}")
    ends = df.where("kind = 'c'").select(
        F.lit("insert").alias("kind"), "key", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("event_id").alias("end_id"),
        F.lit(1).alias("n_events"), F.array("event_id").alias("event_ids"), F.col("event_id").alias("match_id"), F.lit(None).cast("long").alias("old_match_id"),
        F.col("time_bucket").alias("end_bucket"),
    )
    ends.write.partitionBy("end_bucket").parquet(f"{store}/changes/revision={n}")


def test_store_stays_small_over_fifty_batches(spark, tmp_path):
    events = sorted(random_events(12, n=150, keys=2, kinds="abc", span=900), key=lambda e: e["t"] + (e["id"] * 7919) % 40)
    s, store = spec("a b c", "20 min"), str(tmp_path / "store")
    for n in range(50):
        if n and n % 10 == 0:
            m = compact(spark, store, s, n)
            assert m.upto == n - 1 and not numbered(spark, f"{store}/events", "revision")
        deltas(spark, store, n, s, events[3 * n : 3 * n + 3])
    m = compact(spark, store, s, 50)
    assert not numbered(spark, f"{store}/changes", "revision") and len(numbered(spark, f"{store}/manifest", "gen")) == 1
    for kind in ("events", "matches"):
        held = files_of(store, kind)
        assert set(held.values()) == {1} and len(held) == len(m.buckets[kind]) > 10
    rows = snapshots.read_snapshot(spark, store, "events", m).select("event_id").collect()
    assert sorted(r.event_id for r in rows) == list(range(150))
    assert id_sets(current_matches(spark, store, s)) == {(e["id"],) for e in events if e["kind"] == "c"}


@pytest.fixture(scope="module")
def half_store(spark, tmp_path_factory):
    """A store after two batches that overlap in time."""
    events = sorted(random_events(5, n=90, keys=2, kinds="abc"), key=lambda e: e["t"] + (e["id"] * 7919) % 30)
    s, store = spec("a b+ c", "15 min", mode="maximal"), str(tmp_path_factory.mktemp("half") / "store")
    for n in range(2):
        correct(timed(spark, events[30 * n : 30 * n + 30]), n, s, store)
    return events, s, store


@pytest.mark.parametrize("fail_at,call", [("write_buckets", 2), ("write_manifest", 1), ("clean", 2)])
def test_a_merge_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch, half_store, fail_at, call):
    events, s, first = half_store
    store, calls, whole = str(tmp_path / "store"), [], getattr(snapshots, fail_at)
    shutil.copytree(first, store)

    def breaks(*args):
        calls.append(1)
        if len(calls) == call:
            raise RuntimeError("lost")
        return whole(*args)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, fail_at, breaks)
        with pytest.raises(RuntimeError):
            compact(spark, store, s, 2)
    half = id_sets(match(timed(spark, events[:60]), s))
    assert id_sets(current_matches(spark, store, s)) == half
    m = compact(spark, store, s, 2)
    assert m.upto == 1 and id_sets(current_matches(spark, store, s)) == half
    for _ in range(2):  # a repeated batch changes nothing
        correct(timed(spark, events[60:]), 2, s, store)
    assert id_sets(current_matches(spark, store, s)) == id_sets(match(timed(spark, events), s))


def test_expiry_refuses_what_its_window_may_miss(spark, tmp_path):
    events, minutes = random_events(3, n=160, keys=2, kinds="abc"), 90
    for k, e in enumerate(events):
        e["t"] = e["t"] * 7 + k % 5  # a long stream: several windows
    order = sorted(events, key=lambda e: e["t"] + (200 if e["id"] % 9 == 0 else (e["id"] * 31) % 25))
    s, store = spec("a b c", f"{minutes} min"), str(tmp_path / "store")
    horizon, accepted, width = None, [], minutes * 60_000_000
    for n in range(5):
        if n:
            m = compact(spark, store, s, n, expire=True)
            horizon = max(e["t"] for e in accepted)
            assert all((b + 1) * width > m.horizon - 2 * width for b in m.buckets["events"])
            assert all((b + 1) * width > m.horizon - width for b in m.buckets["matches"])
        part = order[32 * n : 32 * n + 32]
        accepted += [e for e in part if horizon is None or e["t"] >= horizon - minutes]
        correct(timed(spark, part), n, s, store, expire=True)
    assert len(accepted) < len(events)
    refused = spark.read.option("recursiveFileLookup", True).parquet(f"{store}/refused")
    assert {r.event_id for r in refused.collect()} == {e["id"] for e in events} - {e["id"] for e in accepted}
    want = match(timed(spark, accepted), s)
    cut = BASE + dt.timedelta(minutes=max(e["t"] for e in accepted) - minutes)
    want = id_sets(want.where(want.end_ts >= cut))
    assert want and id_sets(live_matches(spark, store, s)) == want


def test_gate_keeps_two_states(spark, tmp_path):
    df = spark.createDataFrame([(i, i, "a", 1, i) for i in range(60)], "event_id long, ts long, event_type string, source long, arrival_seq long")
    gate = LatenessGate(spark.createDataFrame([("a", 3)], "event_type string, est_interval_ms long"), 50, str(tmp_path), chunk=10)
    for n in range(6):
        kept, _ = gate(df.where((df.arrival_seq >= 10 * n) & (df.arrival_seq < 10 * n + 10)), n)
        assert kept.count() == 10
        gate.release()
        assert gate.cached is None
    assert len(numbered(spark, f"{tmp_path}/latest", "revision")) <= 3


def test_a_batch_matches_on_small_tables_without_unused_columns(spark, tmp_path, monkeypatch):
    events, s, store = random_events(7, n=60, keys=3, kinds="abc"), spec("a b+ c", "15 min", mode="maximal"), str(tmp_path / "store")
    df, read, whole = timed(spark, events).withColumn("props", F.lit("x")), [], streaming_store.match_at_end

    def seen(around, *args, **kw):
        read.append((around.rdd.getNumPartitions(), around.columns))
        return whole(around, *args, **kw)

    monkeypatch.setattr(streaming_store, "match_at_end", seen)
    monkeypatch.setattr(streaming_store, "remove", lambda *_: None)  # the tables stay to be counted
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for n in range(2):
            correct(df.where(F.col("event_id") % 2 == n), n, s, store)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert all(parts < 16 and "props" not in columns for parts, columns in read) and len(read) == 2
    assert id_sets(current_matches(spark, store, s)) == id_sets(match(df, s))


def test_slim_events_match_alike_under_all_conditions(spark):
    events = [e | {"v": e["id"] % 7} for e in random_events(6, n=80, keys=2, kinds="abcn")]
    rows = [(e["id"], BASE + dt.timedelta(minutes=e["t"]), e["kind"], e["key"], e["v"]) for e in events]
    df = spark.createDataFrame(rows, SCHEMA + ", v long").withColumn("kind", F.when(F.col("event_id") % 11 > 0, F.col("kind")))
    b = Step("b", F.col("kind") == "b", kleene=True, first_when="v > 1", iter_when=lambda cur, prev: cur["v"] >= prev["v"])
    one = PatternSpec([Step("a", "kind = 'a'"), b, Step("c", "kind = 'c'")], "20 min", partition_by=["key"], payload=["v"])
    two = PatternSpec([Step("a", "kind = 'a'"), Step("n", "kind = 'n'", negated=True), Step("c", "kind = 'c'")], "20 min", partition_by=["key"], policy="next")
    for s in (one, two):
        narrow, used_by = slim(df, s)
        assert "kind" not in narrow.columns
        assert id_sets(match(narrow, used_by)) == id_sets(match(df, s)) != set()
