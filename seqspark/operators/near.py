"""The part of an event table that decides the matches of given ends."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, ticks
from ..plans.base import as_column
from ..spec import PatternSpec


def slim(events: DataFrame, spec: PatternSpec) -> tuple[DataFrame, PatternSpec]:
    """What matching reads of the events, their steps' conditions as flags, and the pattern over these."""
    flags, steps = [], []
    for i, s in enumerate(spec.steps):
        asked = {k: c for k in ("when", "first_when") if (c := getattr(s, k)) is not None}
        flags += [F.coalesce(as_column(c), F.lit(False)).alias(f"_{k}_{i}") for k, c in asked.items()]
        steps.append(replace(s, **{k: F.col(f"_{k}_{i}") for k in asked}))
    used = dict.fromkeys([*spec.keys, spec.id, spec.ts, *spec.payload])
    return events.select(*used, *flags), spec.but(steps=steps)


def near_ends(events: DataFrame, ends: DataFrame, spec: PatternSpec) -> DataFrame:
    """Events in the time buckets that decide the matches of the given ends."""
    width = max(1, duration_ticks(events, spec.ts, spec.within))
    own = bucket_of(ticks(events, spec.ts), width)
    marked = events.withColumn("_k", own)
    wanted = events.where(as_column(spec.positive[-1].when))
    wanted = wanted.select(*spec.keys, F.col(spec.id).alias("end_id"), own.alias("_k"))
    wanted = wanted.join(ends.select("end_id").distinct(), "end_id", "left_semi")
    k = F.col("_k")
    wanted = wanted.select(*spec.keys, F.explode(F.array(k, k - 1, k - 2)).alias("_k")).distinct()
    return marked.join(wanted, [*spec.keys, "_k"], "left_semi").drop("_k")
