"""Duplicates, order and set comparison."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, from_ticks, ticks
from ..plans.base import prepare
from ..plans.sliding import window_extrema
from ..spec import PatternSpec


def dedup_events(df: DataFrame, by=("source", "event_type", "ts"), order: str = "arrival_seq") -> DataFrame:
    """Keep the first arrival among rows with equal ``by``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*by, "_row.*").select(*df.columns)


def distinct_matches(m: DataFrame) -> DataFrame:
    """Matches with the same events count once (per query)."""
    query = ["query_id"] if "query_id" in m.columns else []
    return m.dropDuplicates([*query, "match_id", "event_ids"])


def compare_matches(found: DataFrame, truth: DataFrame, by=(), key: str = "match_id") -> DataFrame:
    """True and false positives, false negatives, precision and recall per group.

    The key is a hash, so where both tables list ``event_ids`` these are compared with it.
    """
    by = list(by)
    same = [key, *(["event_ids"] if "event_ids" in found.columns and "event_ids" in truth.columns else [])]
    f = found.select(*by, *same).distinct().withColumn("_f", F.lit(1))
    t = truth.select(*by, *same).distinct().withColumn("_t", F.lit(1))
    hit, extra, missed = (
        F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()),
        F.count_if(F.col("_t").isNull()),
        F.count_if(F.col("_f").isNull()),
    )
    counts = f.join(t, [*by, *same], "full_outer").groupBy(*by).agg(
        hit.alias("tp"), extra.alias("fp"), missed.alias("fn")
    )
    tp = F.col("tp")
    return counts.select(
        *by, "tp", "fp", "fn",
        (tp / F.nullif(tp + F.col("fp"), F.lit(0))).alias("precision"),
        (tp / F.nullif(tp + F.col("fn"), F.lit(0))).alias("recall"),
    )


def sort_by_event_time(df: DataFrame, ts: str = "ts", id: str = "event_id") -> DataFrame:
    return df.orderBy(ts, id)


def sort_by_ingestion(df: DataFrame, order: str = "arrival_seq", within_partitions: bool = False) -> DataFrame:
    """Order of arrival; inside each partition only when that is enough."""
    return df.sortWithinPartitions(order) if within_partitions else df.orderBy(order)


def first_last_in_window(
    df: DataFrame, by=(), span: timedelta | str | int = "1 day", *, ts: str = "ts", id: str = "event_id",
    starts: Column | None = None, ends: Column | None = None,
) -> DataFrame:
    """Per key and fixed time span: the earliest start event and the latest end event."""
    width = duration_ticks(df, ts, span)
    t = ticks(df, ts)
    who = F.struct(t.alias("t"), F.col(id).alias("id"))
    first = F.min(who if starts is None else F.when(starts, who))
    last = F.max(who if ends is None else F.when(ends, who))
    out = df.groupBy(*by, bucket_of(t, width).alias("_k")).agg(first.alias("_a"), last.alias("_z"))
    return out.select(
        *by, from_ticks(df, ts, F.col("_k") * width).alias("span_start"),
        F.col("_a.id").alias("first_id"), F.col("_z.id").alias("last_id"),
    )


def first_last_per_end(events: DataFrame, spec: PatternSpec) -> DataFrame:
    """Per event of the last step: the first and last event of every earlier step in its own window.

    Columns: the keys, ``end_ts``, ``end_id`` and per step ``first_<step>`` and ``last_<step>`` (id, ts), null where
    the window ``[end - within, end)`` holds none; an end that lacks a step has no match.
    """
    p = prepare(events, spec)
    *early, last = spec.positive
    t = F.col("_e")["t"]
    who = F.struct(t.alias("t"), F.col("_e")["id"].alias("id"))
    measures = {}
    for s in early:
        for kind, name in (("min", "first"), ("max", "last")):
            measures[f"{name}_{s.name}"] = (kind, F.when(p.flag(s), who))
    flags = F.col("_e").isNotNull()
    for i, s in enumerate(early):
        flags = p.flag(s) if i == 0 else flags | p.flag(s)
    rows = p.df.where(flags).withColumn("_t", t)
    ends = p.rows(last).select(*spec.keys, t.alias("_t"), F.col("_e")["id"].alias("end_id"))
    out = window_extrema(rows, ends, spec.keys, p.within, p.chunk, measures, strict=True)
    found = out.join(ends, [*spec.keys, "end_id"])

    def shown(name):
        return F.when(F.col(name).isNotNull(), F.struct(F.col(name)["id"].alias("id"), p.time(F.col(name)["t"]).alias("ts"))).alias(name)

    return found.select(*spec.keys, p.time(F.col("_t")).alias("end_ts"), "end_id", *[shown(n) for n in measures])
