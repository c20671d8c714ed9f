"""Event tables: order, duplicates, disturbance, delimited files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import (
    dedup_events,
    first_last_in_window,
    inject_delay,
    inject_disorder,
    inject_duplicates,
    latency_stats,
    match,
    running_max_ts,
    slide_stats,
    sort_by_event_time,
    sort_by_ingestion,
)
from ..functions import from_ticks, map_symbol, ticks, unmap_symbol
from ..sources import read_check_events, read_json_events, read_ohlcv_events, read_stock_events, replay_range
from ..sources.messages import quarantine
from .registry import ABC, ARR, A, B, C, arrivals, events, pattern, query, scratch


@query(
    "running_max_ts",
    f"""WITH {ARR} SELECT event_id, source, event_type, max(ts) OVER (PARTITION BY source, event_type
    ORDER BY arrival_seq) AS max_ts FROM arr""",
)
def q_running_max(spark, d):
    out = running_max_ts(arrivals(spark, d), chunk=1000)
    return out.select("event_id", "source", "event_type", "max_ts")


@query("sort_by_event_time", "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id")
def q_sort(spark, d):
    return sort_by_event_time(events(spark, d)).select("event_id", "ts", "event_type")


@query("sort_by_ingestion", f"WITH {ARR} SELECT event_id, arrival_seq FROM arr ORDER BY arrival_seq")
def q_sort_arrival(spark, d):
    out = sort_by_ingestion(arrivals(spark, d)).select("event_id", "arrival_seq")
    return out.withColumn("arrival_seq", F.col("arrival_seq").cast("long"))


@query(
    "first_last_in_window",
    """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS span_start,
    coalesce(arg_min(event_id, ts) FILTER (event_type = 'view'), -1) AS first_id,
    coalesce(arg_max(event_id, ts) FILTER (event_type = 'purchase'), -1) AS last_id FROM events GROUP BY ALL""",
)
def q_first_last(spark, d):
    out = first_last_in_window(
        events(spark, d), ["user_id"], "1 d",
        starts=F.col("event_type") == "view", ends=F.col("event_type") == "purchase",
    )
    return out.na.fill(-1, ["first_id", "last_id"])


# Constants of the repeatable numbers used to disturb tables.
def lehmer(seed: int, draw: int = 0) -> str:
    x = f"((event_id % 2147483647) * 48271 + {(seed + 1) * 69621 + draw * 1000003}) % 2147483647"
    for _ in range(2):
        x = f"(({x}) * ({x}) + ({x}) * 69621 + 11) % 2147483647"
    return f"(({x}) / 2147483647.0::DOUBLE)"


DUPES = f"""dup AS (SELECT *, unnest(CASE WHEN {lehmer(7)} < 0.3 THEN [0, 1] ELSE [0] END) AS copy FROM events)"""


@query("inject_duplicates", f"WITH {DUPES} SELECT event_id, CAST(copy AS BIGINT) AS copy FROM dup")
def q_duplicates(spark, d):
    out = inject_duplicates(events(spark, d), 0.3, seed=7)
    return out.select("event_id", F.col("copy").cast("long").alias("copy"))


@query(
    "dedup_events",
    f"""WITH {DUPES}, o AS (SELECT * EXCLUDE (event_id), event_id * 2 + copy AS event_id FROM dup)
    SELECT user_id, event_type, ts, min(event_id) AS event_id FROM o GROUP BY ALL""",
)
def q_dedup(spark, d):
    twice = inject_duplicates(events(spark, d), 0.3, seed=7)
    twice = twice.withColumn("event_id", F.col("event_id") * 2 + F.col("copy"))
    out = dedup_events(twice, ("user_id", "event_type", "ts"), "event_id")
    return out.select("user_id", "event_type", "ts", "event_id")


@query(
    "inject_delay",
    f"""SELECT event_id, ts, ts + to_seconds(CASE WHEN {lehmer(3)} < 0.4 THEN
    CAST(floor({lehmer(3, 1)} * 121) AS BIGINT) + 120 ELSE 0 END) AS ingest_ts FROM events""",
)
def q_delay(spark, d):
    return inject_delay(events(spark, d), 0.4, 120, 240, seed=3).select("event_id", "ts", "ingest_ts")


def disorder(prob: float, seed: int) -> str:
    """Events with ``out_of_order`` and ``arrival_seq``."""
    u = "(u1 * 71)"
    return f"""SELECT * EXCLUDE (u0, u1, lag), row_number() OVER (ORDER BY ts + to_minutes(CASE WHEN out_of_order
      THEN lag ELSE 0 END), event_id) AS arrival_seq FROM (SELECT *, u0 < {prob} AS out_of_order,
      CASE WHEN {u} < 30 THEN 1 WHEN {u} < 50 THEN 2 WHEN {u} < 60 THEN 3 WHEN {u} < 65 THEN 5 WHEN {u} < 68 THEN 10
      WHEN {u} < 70 THEN 20 ELSE 60 END AS lag
      FROM (SELECT *, {lehmer(seed)} AS u0, {lehmer(seed, 1)} AS u1 FROM events))"""


@query("inject_disorder", f"SELECT event_id, out_of_order, arrival_seq FROM ({disorder(0.2, 5)})")
def q_disorder(spark, d):
    out = inject_disorder(events(spark, d), 0.2, seed=5)
    return out.select("event_id", "out_of_order", F.col("arrival_seq").cast("long").alias("arrival_seq"))


# Matches with the ingestion of their first event and a time of detection.
DETECTED = f"""det AS (WITH {ABC} SELECT a.ts + to_seconds(a.event_id % 7) AS ingest_ts, c.ts AS end_ts,
    c.ts + to_seconds(c.event_id % 11) AS detect_ts FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts
    JOIN c ON c.user_id = a.user_id AND c.ts > b.ts AND c.ts <= a.ts + INTERVAL 3 DAY)"""
LAG = "(epoch_us(detect_ts) - epoch_us(ingest_ts)) / 1000.0::DOUBLE"


def detected(spark, d):
    e = events(spark, d)
    m = match(e, pattern(A(), B(), C()))

    def plus(col, seconds):
        return from_ticks(m, "end_ts", ticks(m, col) + seconds * 1_000_000)

    return m.withColumn("ingest_ts", plus("start_ts", F.get("event_ids", F.lit(0)) % 7)).withColumn(
        "detect_ts", plus("end_ts", F.col("end_id") % 11)
    )


@query(
    "latency_stats",
    f"""WITH {DETECTED} SELECT count(*) AS matches, round(max({LAG}), 1) AS max_ms, round(min({LAG}), 1) AS min_ms,
    round(avg({LAG}), 1) AS avg_ms FROM det""",
)
def q_latency(spark, d):
    out = latency_stats(detected(spark, d))
    return out.select("matches", *[F.round(c, 1).alias(c) for c in ("max_ms", "min_ms", "avg_ms")])


@query(
    "latency_stats_numeric",
    """SELECT count(*) AS matches, max(l) AS max_ms, min(l) AS min_ms, round(avg(l), 6) AS avg_ms FROM (
    SELECT CAST(event_id % 11 AS DOUBLE) AS l FROM events)""",
)
def q_latency_numeric(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("ingest_ts"), (F.col("event_id") + F.col("event_id") % 11).alias("detect_ts"))
    return latency_stats(e).withColumn("avg_ms", F.round("avg_ms", 6))


@query(
    "slide_stats_numeric",
    """SELECT event_id // 500 * 500 AS slide_start, count(*) AS matches, max(event_id % 11)::DOUBLE AS max_ms FROM events GROUP BY 1""",
)
def q_slide_numeric(spark, d):
    e = events(spark, d).select(
        F.col("event_id").alias("end_ts"), F.col("event_id").alias("ingest_ts"), (F.col("event_id") + F.col("event_id") % 11).alias("detect_ts")
    )
    return slide_stats(e, 500).select("slide_start", "matches", "max_ms")


@query(
    "slide_stats",
    f"""WITH {DETECTED} SELECT time_bucket(INTERVAL 6 HOUR, end_ts, TIMESTAMP '1970-01-01') AS slide_start,
    count(*) AS matches, round(max({LAG}), 1) AS max_ms, round(min({LAG}), 1) AS min_ms, round(avg({LAG}), 1) AS avg_ms
    FROM det GROUP BY 1""",
)
def q_slide(spark, d):
    out = slide_stats(detected(spark, d), "6 hours")
    return out.select("slide_start", "matches", *[F.round(c, 1).alias(c) for c in ("max_ms", "min_ms", "avg_ms")])


@query(
    "replay_range",
    """SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'
    AND event_type IN ('view', 'click')""",
)
def q_replay(spark, d):
    at = [F.lit(t).cast(T.TimestampNTZType()) for t in ("2024-01-05", "2024-01-12")]
    return replay_range(events(spark, d), at[0], at[1], ["view", "click"])


CODE = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 9 END"


@query(
    "map_symbol",
    f"""SELECT event_id, CASE {CODE} WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'unknown' END AS symbol,
    CASE {CODE} WHEN 9 THEN -1 ELSE {CODE} END AS code FROM events""",
)
def q_symbol(spark, d):
    letter = map_symbol(F.expr(CODE))
    out = events(spark, d).select("event_id", letter.alias("symbol"))
    known = F.nullif(F.col("symbol"), F.lit("unknown"))
    back = F.when(known.isNotNull(), unmap_symbol(known))
    return out.withColumn("code", F.coalesce(back, F.lit(-1)))


STOCK = f"""SELECT event_id, epoch_us(ts) // 1000 AS ts, CAST({CODE} AS INTEGER) AS symbol,
    CAST(floor(value) AS INTEGER) AS price, CAST(user_id AS INTEGER) AS volume FROM events"""


def as_stock(spark, d):
    e = events(spark, d)
    millis = F.call_function("div", ticks(e, "ts"), F.lit(1000).cast("long"))
    return e.select("event_id", millis.alias("ts"), F.expr(CODE).alias("symbol"),
                    F.floor("value").alias("price"), F.col("user_id").alias("volume"))


@query("read_stock_events", STOCK)
def q_stock(spark, d):
    path = scratch(spark)
    as_stock(spark, d).select(F.concat_ws(", ", "*").alias("value")).write.text(path)
    return read_stock_events(spark, path)


@query(
    "stock_pattern",
    f"""WITH s AS ({STOCK}), m AS (SELECT a.volume, a.event_id AS i0, b.event_id AS i1, c.event_id AS i2
      FROM s a JOIN s b ON a.volume = b.volume AND b.ts > a.ts JOIN s c ON c.volume = a.volume AND c.ts > b.ts
      AND c.ts <= a.ts + 86400000 WHERE a.symbol = 0 AND b.symbol = 1 AND c.symbol = 2) SELECT * FROM m""",
)
def q_stock_pattern(spark, d):
    from ..spec import PatternSpec, Step

    path = scratch(spark)
    as_stock(spark, d).select(F.concat_ws(",", "*").alias("value")).write.text(path)
    steps = [Step(n, f"symbol = {i}") for i, n in enumerate("abc")]
    m = match(read_stock_events(spark, path), PatternSpec(steps, within=86_400_000, partition_by=["volume"]))
    return m.select("volume", *[F.get("event_ids", F.lit(i)).alias(f"i{i}") for i in range(3)])


@query(
    "read_check_events",
    """SELECT event_id, epoch_us(ts) // 1000 AS ts, 'u' || user_id AS src, event_type || event_id AS dst,
    CAST(user_id AS INTEGER) AS src_no, CAST(event_id AS INTEGER) AS dst_no FROM events""",
)
def q_check(spark, d):
    path = scratch(spark)
    e = events(spark, d)
    millis = F.call_function("div", ticks(e, "ts"), F.lit(1000).cast("long"))
    line = F.concat_ws(", ", "event_id", millis, F.concat(F.lit("u"), "user_id"), F.concat("event_type", "event_id"))
    e.select(line.alias("value")).write.text(path)
    return read_check_events(spark, path)


TICKER = "CASE user_id % 5 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'AMZN' WHEN 2 THEN 'FB' WHEN 3 THEN 'AVID' ELSE 'IBM' END"


@query(
    "read_ohlcv_events",
    f"""SELECT {TICKER} AS key, event_id AS ts, value AS open, value + 1 AS peak, value - 1 AS low, value + 0.5 AS close,
    CAST(user_id AS DOUBLE) AS volume, CAST(CASE WHEN user_id % 5 < 4 THEN user_id % 5 ELSE -1 END AS INTEGER) AS symbol FROM events""",
)
def q_ohlcv(spark, d):
    path = scratch(spark)
    v = F.col("value")
    cols = [F.expr(TICKER), F.col("event_id"), v, v + 1, v - 1, v + 0.5, F.col("user_id")]
    events(spark, d).select(F.concat_ws(",", *[c.cast("string") for c in cols]).alias("value")).write.text(path)
    return read_ohlcv_events(spark, path).drop("event_id").na.fill(-1, ["symbol"])


@query(
    "ohlcv_event_ids",
    f"""SELECT {TICKER} AS key, count(*) AS ticks, count(DISTINCT (event_id // 50, value, user_id)) AS ids FROM events
    GROUP BY 1""",
)
def q_ohlcv_ids(spark, d):
    """Fifty ticks share a time; ids tell all of them apart that differ in a field."""
    path = scratch(spark)
    v = F.col("value")
    cols = [F.expr(TICKER), F.floor(F.col("event_id") / 50), v, v + 1, v - 1, v + 0.5, F.col("user_id")]
    events(spark, d).select(F.concat_ws(",", *[c.cast("string") for c in cols]).alias("value")).write.text(path)
    ids = read_ohlcv_events(spark, path).groupBy("key")
    return ids.agg(F.count(F.lit(1)).alias("ticks"), F.countDistinct("event_id").alias("ids"))


@query(
    "read_json_events",
    """SELECT event_id, timezone('EET', date_trunc('second', ts)) AT TIME ZONE 'UTC' AS ts, event_type AS symbol,
    CAST(floor(value) AS INTEGER) AS price, value AS volume FROM events WHERE event_id % 10 <> 0""",
)
def q_json(spark, d):
    path = scratch(spark)
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.col("event_type").alias("symbol"), F.floor("value").cast("int").alias("price"),
            F.col("value").alias("volume"), F.lit(False).alias("out_of_order"),
        )
    )
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{oops "), body)).otherwise(body)
    events(spark, d).select(broken.alias("value")).write.text(path)
    good, _ = quarantine(read_json_events(spark, path))
    at = F.convert_timezone(None, F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
    return good.select("event_id", at.alias("ts"), "symbol", "price", "volume")
