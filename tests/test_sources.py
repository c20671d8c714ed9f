"""Readers, message kinds, Kafka options and sinks."""

import datetime as dt
import json

import pytest
from helpers import frame, named, spec
from pyspark.sql import functions as F

import seqspark as sq
from seqspark.sources.kafka import kafka_messages, replay_options

LINES = ["1, 1, 1, 1, 876", "2, 2, 0, 5, 942", "3, 3, 2, 7, 11"]


@pytest.mark.parametrize("blank", [" ", ""])
def test_stock_lines_with_and_without_blanks(spark, tmp_path, blank):
    (tmp_path / "s.txt").write_text("\n".join(x.replace(", ", "," + blank) for x in LINES))
    rows = sq.read_stock_events(spark, str(tmp_path)).orderBy("event_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 1, 876), (2, 2, 0, 5, 942), (3, 3, 2, 7, 11)]
    stream = sq.read_stock_events(spark, str(tmp_path), streaming=True)
    assert stream.isStreaming and stream.columns == ["event_id", "ts", "symbol", "price", "volume"]


def test_check_and_ohlcv(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x").write_text("1, 5, node17, n3\n2, 6, abc, n4x2\n")
    rows = sq.read_check_events(spark, str(tmp_path / "c")).orderBy("event_id").collect()
    assert [(r.src_no, r.dst_no) for r in rows] == [(17, 3), (None, 42)]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x").write_text("FB,10,1.5,2,1,1.75,100\nIBM,11,1,2,1,2,5\n")
    rows = sq.read_ohlcv_events(spark, str(tmp_path / "o")).orderBy("ts").collect()
    assert [(r.symbol, r.close) for r in rows] == [(2, 1.75), (None, 2.0)]
    assert rows[0].event_id != rows[1].event_id
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("FB,10,1,2,1,1,100\nFB,10,1,2,1,1,200\nFB,10,1,2,1,,200\n")
    ids = [r.event_id for r in sq.read_ohlcv_events(spark, str(tmp_path / "t")).collect()]
    assert len(set(ids)) == 3


def test_json_and_quarantine(spark, tmp_path):
    good = {"id": 7, "timestamp": "2025-02-01T10:00:00", "symbol": "z", "price": 35, "volume": 422, "out_of_order": False}
    late = {**good, "id": 8, "timestamp": "soon"}
    (tmp_path / "j").write_text("\n".join([json.dumps(good), "{broken", json.dumps(late)]))
    ok, bad = sq.quarantine(sq.read_json_events(spark, str(tmp_path)))
    assert [r.event_id for r in ok.collect()] == [7] and bad.count() == 2
    assert ok.first().ts == dt.datetime(2025, 2, 1, 8, 0)  # ten o'clock in the source zone


def message(**kw):
    return json.dumps(kw)


def test_every_kind(spark):
    at = "2025-07-01T10:00:00"
    rows = [
        (1, "ABC", message(id=4, timestamp=at, symbol="b", price=3, volume=9.5)),
        (2, "fitbit", message(fitbit=dict(timestamp=at, steps=100.0, stairs=3.0, naps=1.0))),
        (3, "Scale", message(scale=dict(timestamp=at, weight=70.5, height=175.0, bmi=22.5, bmiCategory="ok"))),
        (4, "Locations", message(location="Bedroom", timestamp=at, dateEntered=at, dateUpdate=at,
                                 totalActivations=5, recentActivations=2)),
        (5, "Unknown", "{}"),
        (6, "Terminate", message(Terminate=True, message="stop")),
        (7, "ABC", message(id=5, timestamp=at, symbol="c", price=1, volume=1.0)),
    ]
    df = spark.createDataFrame(rows, "arrival_seq long, kind string, value string")
    good, bad = sq.quarantine(sq.normalise(df))
    assert sorted((r.arrival_seq, r._raw) for r in bad.collect()) == [(5, "{}"), (6, message(Terminate=True, message="stop"))]
    out = {r.name: r for r in good.collect()}
    assert set(out) == {"b4", "steps_2", "stairs_2", "naps_2", "weight_3", "height_3", "bmi_3", "bmiCat_3", "location_4", "c5"}
    assert (out["b4"].event_type, out["b4"].value, out["b4"].symbol, out["b4"].source) == ("b", 9.5, 3, "Abc")
    assert (out["naps_2"].event_type, out["naps_2"].symbol, out["naps_2"].value) == ("Naps", 4, 1.0)
    assert (out["bmiCat_3"].value, out["bmiCat_3"].value_str) == (None, "ok")
    room = out["location_4"]
    assert (room.event_type, room.source, room.patient_id) == ("Bedroom", "Locations", 10)
    assert room.position.total_activations == 5 and room.ts == dt.datetime(2025, 7, 1, 7, 0)
    before = sq.until_sentinel(df)
    assert sorted(r.arrival_seq for r in before.collect()) == [1, 2, 3, 4, 5]
    assert sq.until_sentinel(before).count() == 5


def test_damaged_fields_are_rejected(spark):
    rows = [(1, message(id=1, timestamp="2025-07-01T10:00:00", symbol="b", price="oops")), (2, "{broken"), (3, None)]
    good, bad = sq.quarantine(sq.normalise_abc(spark.createDataFrame(rows, "arrival_seq long, value string")))
    assert good.count() == 0 and sorted((r.arrival_seq, r._raw) for r in bad.collect()) == [(n, v) for n, v in rows]


def test_topics_and_kafka_options(spark):
    df = spark.createDataFrame([('{"fitbit": {}}',), ('{"scale": 1}',), ('{"location": "x"}',), ('{"id": 1}',)], "value string")
    assert [r.topic for r in sq.with_topic(df).collect()] == ["Fitbit", "Scale", "Locations", "Abc"]
    options = sq.kafka_options("host:9092", ["Fitbit", "Scale"], headers=True)
    assert options["subscribe"] == "Fitbit,Scale" and options["startingOffsets"] == "earliest"
    assert options["includeHeaders"] == "true"
    assert replay_options("h", ["x"], 5, 9)["endingTimestamp"] == "9"
    raw = spark.createDataFrame(
        [("Abc", bytearray(b"{}"), bytearray(b"k"), p, o, dt.datetime(2024, 1, 1, h)) for p, o, h in ((1, 3, 5), (0, 7, 4), (0, 8, 5))],
        "topic string, value binary, key binary, partition int, offset long, timestamp timestamp",
    )
    got = kafka_messages(raw).orderBy("arrival_seq").collect()
    assert [(r.kind, r.value, r.partition, r.offset) for r in got] == [("Abc", "{}", 0, 7), ("Abc", "{}", 0, 8), ("Abc", "{}", 1, 3)]


def test_kafka_rows_pass_the_lateness_gate(spark, tmp_path):
    kinds = "abc"
    rows = []
    for i in range(30):
        body = json.dumps({"id": i, "timestamp": f"2024-01-01T00:{(i * 7) % 60:02d}:00", "symbol": kinds[i % 3], "price": 1, "volume": 1})
        rows.append(("Abc", bytearray(body.encode()), None, i % 2, i // 2, dt.datetime(2024, 1, 1, 1, i // 4)))
    raw = spark.createDataFrame(rows, "topic string, value binary, key binary, partition int, offset long, timestamp timestamp").repartition(3)
    order = sorted(range(30), key=lambda i: (rows[i][5], rows[i][3], rows[i][4]))
    sources = spark.createDataFrame([(k, 60_000) for k in kinds], "event_type string, est_interval_ms long")
    gate = sq.LatenessGate(sources, "1 h", str(tmp_path / "gate"), by=("event_type",), chunk=10)
    seen = []
    for revision, part in enumerate((order[:12], order[12:])):
        ids = spark.createDataFrame([(i % 2, i // 2) for i in part], "partition int, offset long")
        batch = sq.number_arrivals(kafka_messages(raw.join(ids, ["partition", "offset"], "left_semi")), revision)
        events = sq.normalise(batch, "kind")
        assert dict(events.dtypes)["arrival_seq"] == "bigint"
        judged = sq.classify_lateness(events, sources, ["event_type"], chunk=10)
        assert judged.where("status is null").count() == 0
        kept, dropped = gate(events, revision)
        both = kept.select("name", "arrival_seq").union(dropped.select("name", "arrival_seq")).collect()
        seen += [r.name for r in sorted(both, key=lambda r: r.arrival_seq)]
        assert all(r.arrival_seq >> 40 == revision for r in both)
        gate.release()
    assert [int("".join(c for c in x if c.isdigit())) for x in seen] == order


def test_unmap_refuses_unknown(spark):
    df = spark.createDataFrame([("a",), ("q",)], "s string")
    with pytest.raises(Exception, match="Unknown symbol"):
        df.select(sq.unmap_symbol("s")).collect()
    assert [r[0] for r in df.filter("s = 'a'").select(sq.unmap_symbol("s")).collect()] == [0]


def test_sinks(spark, tmp_path):
    m = sq.match(frame(spark, named(["a1", "b2", "c3"])), spec("a b c", 10))
    sq.write_matches(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().event_ids == [1, 2, 3]
    for _ in range(2):
        sq.write_changelog(m.withColumn("kind", F.lit("insert")), str(tmp_path / "log"), revision=4)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_lateness_follows_arrival(spark):
    rows = [(1, 10, "a", 1), (2, 12, "a", 2), (3, 11, "a", 3), (4, 5, "b", 4), (5, 2, "a", 5)]
    df = spark.createDataFrame(rows, "event_id long, ts long, event_type string, arrival_seq long")
    rates = spark.createDataFrame([("a", 3), ("b", 3)], "event_type string, est_interval_ms long")
    out = sq.classify_lateness(df, rates, ["event_type"], chunk=2).orderBy("event_id").collect()
    assert [r.status for r in out] == ["in_order", "in_order", "minor", "in_order", "late"]
    assert [r.lateness_ms for r in out] == [0, 0, 1, 0, 10]
