"""JSON messages made from the event table and turned back into events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capitalise_source, parse_event_time
from ..sources import (
    normalise,
    normalise_abc,
    normalise_fitbit,
    normalise_location,
    normalise_scale,
    quarantine,
    until_sentinel,
    with_topic,
)
from .registry import events, query

EET = "(timezone('EET', date_trunc('second', ts)) AT TIME ZONE 'UTC')"


def text():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")


def stamp(col="ts"):
    at = F.col(col) if isinstance(col, str) else col
    return F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")).alias("ts")


def abc():
    return F.to_json(
        F.struct(F.col("event_id").alias("id"), text(), F.col("event_type").alias("symbol"),
                 F.col("user_id").cast("int").alias("price"), F.col("value").alias("volume"))
    )


def fitbit():
    v = F.col("value")
    return F.to_json(F.struct(F.struct(text(), v.alias("steps"), (v * 2).alias("stairs"), (v + 1).alias("naps")).alias("fitbit")))


def scale():
    v = F.col("value")
    return F.to_json(
        F.struct(F.struct(text(), v.alias("weight"), (v + 100).alias("height"), (v / 2).alias("bmi"),
                          F.col("event_type").alias("bmiCategory")).alias("scale"))
    )


def location():
    at = text()
    return F.to_json(
        F.struct(F.col("event_type").alias("location"), at, at.alias("dateEntered"), at.alias("dateUpdate"),
                 F.col("user_id").cast("int").alias("totalActivations"),
                 (F.col("user_id") % 7).cast("int").alias("recentActivations"))
    )


def messages(spark, d, body):
    return events(spark, d).select(F.col("event_id").alias("arrival_seq"), body.alias("value"))


def plain(df):
    return df.select("arrival_seq", "name", stamp(), "source", "event_type", "symbol", "value", "value_str")


def reading(name, kind, code, value, source, text="NULL"):
    return f"""SELECT event_id AS arrival_seq, '{name}_' || event_id AS name, {EET} AS ts, '{source}' AS source,
    '{kind}' AS event_type, CAST({code} AS INTEGER) AS symbol, CAST({value} AS DOUBLE) AS value,
    CAST({text} AS VARCHAR) AS value_str FROM events"""


ABC_SQL = f"""SELECT event_id AS arrival_seq, event_type || event_id AS name, {EET} AS ts, 'Abc' AS source, event_type,
    CAST(user_id AS INTEGER) AS symbol, value, CAST(NULL AS VARCHAR) AS value_str FROM events"""
FITBIT_SQL = " UNION ALL ".join(
    [
        reading("steps", "Steps", 1, "value", "Fitbit"),
        reading("stairs", "Stairs", 2, "value * 2", "Fitbit"),
        reading("naps", "Naps", 4, "value + 1", "Fitbit"),
    ]
)
SCALE_SQL = " UNION ALL ".join(
    [
        reading("weight", "Weight", 5, "value", "Scale"),
        reading("height", "Height", 6, "value + 100", "Scale"),
        reading("bmi", "Bmi", 7, "value / 2", "Scale"),
        reading("bmiCat", "BmiCat", 8, "NULL", "Scale", "event_type"),
    ]
)
LOCATION_SQL = f"""SELECT event_id AS arrival_seq, 'location_' || event_id AS name, {EET} AS ts, 'Locations' AS source,
    event_type, CAST(3 AS INTEGER) AS symbol, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS value_str FROM events"""


@query("normalise_abc", ABC_SQL.replace(", CAST(NULL AS VARCHAR) AS value_str", ""))
def q_abc(spark, d):
    return plain(normalise_abc(messages(spark, d, abc()))).drop("value_str")


@query("normalise_fitbit", f"SELECT * EXCLUDE (value_str) FROM ({FITBIT_SQL})")
def q_fitbit(spark, d):
    return plain(normalise_fitbit(messages(spark, d, fitbit()))).drop("value_str")


@query("normalise_scale", SCALE_SQL)
def q_scale(spark, d):
    return plain(normalise_scale(messages(spark, d, scale())))


@query(
    "normalise_location",
    f"""SELECT event_id AS arrival_seq, 'location_' || event_id AS name, {EET} AS ts, event_type, 10 AS patient_id,
    {EET} AS entered, event_type AS room, CAST(user_id AS INTEGER) AS total, CAST(user_id % 7 AS INTEGER) AS recent FROM events""",
)
def q_location(spark, d):
    out = normalise_location(messages(spark, d, location()))
    return out.select(
        "arrival_seq", "name", stamp(), "event_type", F.col("patient_id").cast("int").alias("patient_id"),
        stamp("position.date_entered").alias("entered"), F.col("position.location").alias("room"),
        F.col("position.total_activations").alias("total"), F.col("position.recent_activations").alias("recent"),
    )


KIND = "CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'Fitbit' WHEN 2 THEN 'scale' WHEN 3 THEN 'Locations' ELSE 'other' END"


def mixed(spark, d):
    kind = F.expr(KIND)
    body = (
        F.when(kind == "abc", abc()).when(kind == "Fitbit", fitbit()).when(kind == "scale", scale())
        .when(kind == "Locations", location()).otherwise(F.lit('{"x": 1}'))
    )
    return events(spark, d).select(F.col("event_id").alias("arrival_seq"), kind.alias("kind"), body.alias("value"))


@query(
    "normalise_mixed",
    f"""SELECT * FROM ({ABC_SQL}) WHERE arrival_seq % 5 = 0 UNION ALL SELECT * FROM ({FITBIT_SQL}) WHERE arrival_seq % 5 = 1
    UNION ALL SELECT * FROM ({SCALE_SQL}) WHERE arrival_seq % 5 = 2
    UNION ALL SELECT * FROM ({LOCATION_SQL}) WHERE arrival_seq % 5 = 3""",
)
def q_mixed(spark, d):
    return plain(quarantine(normalise(mixed(spark, d)))[0])


@query(
    "normalise_rejected",
    f"""SELECT event_id AS arrival_seq, {KIND} AS kind, CASE WHEN event_id % 35 = 0 THEN '{{"id": 1, "price": "oops"}}'
    ELSE '{{"x": 1}}' END AS text FROM events WHERE event_id % 35 = 0 OR event_id % 5 = 4""",
)
def q_rejected(spark, d):
    """Unknown kinds, and letters whose price is no number."""
    damaged = F.when(F.col("arrival_seq") % 35 == 0, '{"id": 1, "price": "oops"}').otherwise(F.col("value"))
    bad = quarantine(normalise(mixed(spark, d).withColumn("value", damaged)))[1]
    return bad.select("arrival_seq", "kind", F.col("_raw").alias("text"))


@query(
    "kafka_topic_of_message",
    f"""SELECT event_id AS arrival_seq, CASE event_id % 5 WHEN 1 THEN 'Fitbit' WHEN 2 THEN 'Scale' WHEN 3 THEN 'Locations'
    ELSE 'Abc' END AS topic FROM events""",
)
def q_topic(spark, d):
    return with_topic(mixed(spark, d)).select("arrival_seq", "topic")


BROKEN = "event_id % 11 = 0"


def half_broken(spark, d):
    body = F.when(F.expr(BROKEN), F.concat(F.lit('{"id": 1, "timestamp": "soon", '), F.lit('"symbol": "x"}'))).otherwise(abc())
    return quarantine(normalise_abc(messages(spark, d, body)))


for side, test in (("good", f"NOT ({BROKEN})"), ("bad", BROKEN)):
    query(f"quarantine_{side}", f"SELECT event_id AS arrival_seq FROM events WHERE {test}")(
        lambda spark, d, side=side: half_broken(spark, d)[side == "bad"].select("arrival_seq")
    )


@query(
    "until_sentinel",
    """SELECT event_id AS arrival_seq FROM events WHERE event_id < (SELECT min(event_id) FROM events
    WHERE event_type = 'error' AND value > 100)""",
)
def q_sentinel(spark, d):
    stop = F.lit('{"Terminate": true, "message": "terminate process"}')
    body = F.when(F.expr("event_type = 'error' AND value > 100"), stop).otherwise(abc())
    return until_sentinel(messages(spark, d, body)).select("arrival_seq")


@query(
    "parse_event_time",
    f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '1970-01-01' ELSE {EET} END AS at FROM events",
)
def q_parse(spark, d):
    written = F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    at = F.coalesce(parse_event_time(written), F.timestamp_seconds(F.lit(0)))
    return events(spark, d).select("event_id", stamp(at).alias("at"))


@query(
    "capitalise_source",
    """SELECT event_id, upper(event_type[1]) || event_type[2:] || 'X' AS source FROM events""",
)
def q_capital(spark, d):
    return events(spark, d).select("event_id", capitalise_source(F.concat("event_type", F.lit("X"))).alias("source"))
