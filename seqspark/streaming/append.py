"""Append-only matching of plain steps with stream-stream joins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from ..plans.base import as_column
from ..spec import PatternSpec, micros


def stream_sequence_append(sdf: DataFrame, spec: PatternSpec, delay: str = "10 minutes") -> DataFrame:
    """Every combination (policy any, no one-or-more or negated step), emitted once.

    Rows meet on (keys, time bucket) as in the batch join; the time-range condition and
    the watermark bound the join state.  Events later than ``delay`` are lost: use
    ``stream_match`` where corrections are needed.
    """
    if spec.policy != "any" or spec.has_kleene or any(s.negated or s.cross_when for s in spec.steps):
        raise ValueError("append-only matching takes policy any with plain steps")
    width = max(1, micros(spec.within))
    span = F.expr(f"INTERVAL '{timedelta(microseconds=width) / timedelta(seconds=1):.6f}' SECOND")
    timed = sdf.withColumn("_t", F.col(spec.ts).cast("timestamp"))
    own = bucket_of(F.unix_micros("_t"), width)

    def side(i, step, last):
        buckets = F.array(own) if last else F.array(own, own + 1)
        return (
            timed.filter(as_column(step.when))
            .select(
                *[F.col(k).alias(f"_{i}_{k}") for k in spec.keys],
                F.col("_t").alias(f"_t{i}"), F.col(spec.id).alias(f"_id{i}"),
                F.explode(buckets).alias(f"_k{i}"),
            )
            .withWatermark(f"_t{i}", delay)
        )

    steps = list(spec.steps)
    n = len(steps) - 1
    out = side(0, steps[0], False).withColumn("_u0", F.unix_micros("_t0"))
    for i in range(1, n + 1):
        before, mine = F.col(f"_t{i - 1}"), F.col(f"_t{i}")
        on = (F.col(f"_k{i}") == F.col("_k0")) & (mine > before) & (mine <= before + span)
        for k in spec.keys:
            on = on & (F.col(f"_{i}_{k}") == F.col(f"_0_{k}"))
        out = out.join(side(i, steps[i], i == n), on)
        # A stream keeps one event time: the latest step's.
        out = out.withColumn(f"_u{i}", F.unix_micros(mine)).drop(f"_t{i - 1}")
        out = out.filter(F.col(f"_u{i}") - F.col("_u0") <= width)
    ids = F.array(*[F.col(f"_id{i}") for i in range(n + 1)])
    return out.select(
        *[F.col(f"_0_{k}").alias(k) for k in spec.keys],
        F.timestamp_micros("_u0").alias("start_ts"), F.col(f"_t{n}").alias("end_ts"), F.col(f"_id{n}").alias("end_id"),
        F.lit(n + 1).alias("n_events"), ids.alias("event_ids"), F.xxhash64(ids).alias("match_id"),
    )
