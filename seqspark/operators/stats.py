"""Statistics over events and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.time import bucket_of, in_ms, ticks


def late_measures():
    late = F.col("status") == "late"
    return [
        F.count(F.lit(1)).alias("events"),
        F.count_if(late).alias("late_events"),
        F.avg("lateness_ms").alias("avg_lateness_ms"),
        F.min(F.when(late, F.col("lateness_ms"))).alias("min_lateness_ms"),
        F.max(F.when(late, F.col("lateness_ms"))).alias("max_lateness_ms"),
        F.avg(F.when(late, F.col("score"))).alias("avg_score"),
    ]


def event_stats(df: DataFrame) -> DataFrame:
    """Per event type: events, late events, lateness, score and expected interval."""
    return df.groupBy("event_type").agg(*late_measures(), F.max("est_interval_ms").alias("est_interval_ms"))


def global_stats(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row of totals with ``events_per_sec`` over the span of ``ts``; per 1000 units where time is numeric."""
    t = in_ms(df, ts, ticks(df, ts))
    span = (F.max(t) - F.min(t)) / F.lit(1000.0)
    rate = F.count(F.lit(1)) / F.nullif(span, F.lit(0.0))
    return df.agg(*late_measures(), rate.alias("events_per_sec"))


def stats_rollup(df: DataFrame) -> DataFrame:
    """Per-type rows and the total (null type) in one pass."""
    return df.rollup("event_type").agg(*late_measures())


def latency_stats(m: DataFrame, detect: str = "detect_ts", ingest: str = "ingest_ts") -> DataFrame:
    """Max, min and mean of detection minus ingestion of the first event, in ms (in their own unit if numeric)."""
    lag = in_ms(m, detect, ticks(m, detect)) - in_ms(m, ingest, ticks(m, ingest))
    return m.agg(
        F.count(F.lit(1)).alias("matches"), F.max(lag).alias("max_ms"),
        F.min(lag).alias("min_ms"), F.avg(lag).alias("avg_ms"),
    )


def match_stats(m: DataFrame, by=(), rejected: DataFrame | None = None) -> DataFrame:
    """Matches, late matches (column ``is_ooo`` if present), longest match, rejected ones."""
    late = F.col("is_ooo") if "is_ooo" in m.columns else F.lit(False)
    out = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(late).alias("late_matches"),
        F.max("n_events").alias("longest"),
    )
    if rejected is None:
        return out
    lost = rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("negated_matches"))
    if by:
        joined = out.join(lost, list(by), "full_outer")
    else:
        joined = out.withColumn("_one", F.lit(1)).join(lost.withColumn("_one", F.lit(1)), "_one", "full_outer").drop("_one")
    counts = ["matches", "late_matches", "negated_matches"]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def match_aggregates(m: DataFrame, step: str, attr: str) -> DataFrame:
    """Add min/max/sum/avg/count/last of an attribute over a one-or-more step.

    The attribute must be in the pattern's ``payload``.
    """
    values = F.transform(F.col(step), lambda e: e[attr])
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
    n = F.size(F.filter(values, lambda x: x.isNotNull()))
    return m.select(
        "*",
        F.array_min(values).alias(f"{attr}_min"), F.array_max(values).alias(f"{attr}_max"),
        total.alias(f"{attr}_sum"), (total / F.nullif(n, F.lit(0))).alias(f"{attr}_avg"),
        n.alias(f"{attr}_count"), F.element_at(values, -1).alias(f"{attr}_last"),
    )


def slide_stats(m: DataFrame, slide: str | int, detect: str = "detect_ts", ingest: str = "ingest_ts") -> DataFrame:
    """Matches and latency per slide of end time; a number of units where end time is numeric."""
    lag = in_ms(m, detect, ticks(m, detect)) - in_ms(m, ingest, ticks(m, ingest))
    if isinstance(m.schema["end_ts"].dataType, IntegralType):
        width = int(slide)
        start = bucket_of(ticks(m, "end_ts"), width) * width
        slot = F.struct(start.alias("start")).alias("w")
    else:
        slot = F.window("end_ts", slide).alias("w")
    out = m.groupBy(slot).agg(
        F.count(F.lit(1)).alias("matches"), F.max(lag).alias("max_ms"),
        F.min(lag).alias("min_ms"), F.avg(lag).alias("avg_ms"),
    )
    return out.select(F.col("w.start").alias("slide_start"), "matches", "max_ms", "min_ms", "avg_ms")
