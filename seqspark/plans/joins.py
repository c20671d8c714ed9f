"""Window-bounded joins: equi-join on (keys, time bucket) plus a residual time test."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, ticks


def end_side(df: DataFrame, tick: Column, width: int, salt: int = 1, spread: Column | None = None):
    """The later side keeps its own bucket; ``salt`` deals its rows over that many groups."""
    out = df.withColumn("_k", bucket_of(tick, width))
    return out.withColumn("_z", F.pmod(F.xxhash64(spread), F.lit(salt))) if salt > 1 else out


def early_side(df: DataFrame, tick: Column, width: int, salt: int = 1):
    """The earlier side goes to its own bucket and the one after it.

    With a bucket as wide as the window an earlier event and the end it may serve are at
    most one bucket apart, so every pair meets in exactly one group: the end's.
    """
    own = bucket_of(tick, width)
    out = df.withColumn("_k", F.explode(F.array(own, own + 1)))
    return out.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))) if salt > 1 else out


def meet_on(by, salt: int) -> list[str]:
    return [*by, "_k", *(["_z"] if salt > 1 else [])]


def window_join(
    left: DataFrame,
    right: DataFrame,
    within: timedelta | str | int,
    by=(),
    *,
    ts: str = "ts",
    salt: int = 1,
) -> DataFrame:
    """All pairs with ``left.ts < right.ts <= left.ts + within`` and equal keys.

    Columns come back as the keys, ``l_<column>`` and ``r_<column>``.
    """
    width = max(1, duration_ticks(left, ts, within))

    def side(df, prefix):
        return df.select(
            *by,
            *[F.col(c).alias(prefix + c) for c in df.columns if c not in by],
            ticks(df, ts).alias(f"_{prefix}t"),
        )

    early, late = side(left, "l_"), side(right, "r_")
    spread = F.struct(*[c for c in late.columns if c not in by])
    pairs = end_side(late, F.col("_r_t"), width, salt, spread).join(
        early_side(early, F.col("_l_t"), width, salt), meet_on(by, salt)
    )
    inside = (F.col("_l_t") < F.col("_r_t")) & (F.col("_r_t") - F.col("_l_t") <= width)
    return pairs.filter(inside).select(
        *by,
        *[c for c in early.columns if c.startswith("l_")],
        *[c for c in late.columns if c.startswith("r_")],
    )
