"""Running scans that never put a whole key into one task.

A running value over a key is split in two levels: every (key, time chunk) is scanned on
its own, and each chunk starts from one carry-in row that holds what the chunks before it
add up to.  The carry rows come from a map-side aggregated table with one row per
(key, chunk), so a key holding a third of all events only means more chunks.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, ticks
from .base import as_column

AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}
FAR_BACK = W.unboundedPreceding


def carry_over(totals: DataFrame, by, measures, reverse: bool, levels: int) -> DataFrame:
    """Add to each (key, chunk) what all chunks before it (after it, in reverse) add up to.

    With two levels a key's chunks are scanned as one small group; with three they are
    themselves cut into runs of a thousand.
    """
    if levels > 2:
        strict = {n: (kind, value, True) for n, (kind, value) in measures.items()}
        outer = totals.withColumnRenamed("_chunk", "_at")
        out = running(outer, list(by), "_at", 1000, strict, reverse=reverse, levels=levels - 1)
        return out.withColumnRenamed("_at", "_chunk")
    along = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    before = W.partitionBy(*by).orderBy(along).rowsBetween(FAR_BACK, -1)
    return totals.select("*", *[AGGREGATES[k](v).over(before).alias(n) for n, (k, v) in measures.items()])


def running(
    df: DataFrame,
    by: list[str],
    order: str,
    width: int,
    measures: dict[str, tuple[str, Column, bool]],
    *,
    reverse: bool = False,
    levels: int = 2,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns along the long column ``order``.

    ``measures`` maps a new column to (aggregate, value, strict).  A strict measure leaves
    out the row itself and rows with an equal ``order``; otherwise both are included.
    ``reverse`` runs from the latest row back.  ``levels=3`` also splits the table of chunk
    totals, for chunks so short that one key has millions of them.
    """
    names = list(measures)
    base = df.select(
        "*",
        *[value.alias(f"_m_{n}") for n, (_, value, _) in measures.items()],
        bucket_of(F.col(order), width).alias("_chunk"),
        F.lit(False).alias("_carry"),
    )

    def agg(name):
        return AGGREGATES[measures[name][0]](f"_m_{name}")

    edge = (F.col("_chunk") + 1) * width if reverse else F.col("_chunk") * width - 1
    totals = base.groupBy(*by, "_chunk").agg(*[agg(n).alias(f"_m_{n}") for n in names])
    before = {f"_b_{n}": (measures[n][0], F.col(f"_m_{n}")) for n in names}
    carry = carry_over(totals, by, before, reverse, levels).select(
        *by,
        edge.alias(order),
        "_chunk",
        F.lit(True).alias("_carry"),
        *[F.col(f"_b_{n}").alias(f"_m_{n}") for n in names],
    )
    rows = base.unionByName(carry, allowMissingColumns=True)
    key = F.col(order).desc() if reverse else F.col(order).asc()
    scan = W.partitionBy(*by, "_chunk").orderBy(key)

    def frame(name):
        return scan.rangeBetween(FAR_BACK, -1 if measures[name][2] else 0)

    return (
        rows.select(*df.columns, "_carry", *[agg(n).over(frame(n)).alias(n) for n in names])
        .filter(~F.col("_carry"))
        .drop("_carry")
    )


def neighbour(df, cond, by, ts, payload, chunk, name, reverse, strict):
    width = duration_ticks(df, ts, chunk)
    timed = df.withColumn("_t", ticks(df, ts))
    seen = F.struct("_t", *payload)
    kind = "min" if reverse else "max"
    value = F.when(as_column(cond), seen)
    out = running(timed, list(by), "_t", width, {name: (kind, value, strict)}, reverse=reverse)
    return out.withColumn(name, F.col(name).dropFields("_t")).drop("_t")


def next_event(
    df: DataFrame,
    cond: Column | str,
    by=(),
    *,
    ts: str = "ts",
    payload=("event_id", "ts"),
    chunk: timedelta | str | int = "1 day",
    name: str = "next",
) -> DataFrame:
    """For each event the next strictly later event that satisfies ``cond`` (struct column)."""
    return neighbour(df, cond, by, ts, payload, chunk, name, True, True)


def prev_event(
    df: DataFrame,
    cond: Column | str,
    by=(),
    *,
    ts: str = "ts",
    payload=("event_id", "ts"),
    chunk: timedelta | str | int = "1 day",
    name: str = "prev",
    strict: bool = False,
) -> DataFrame:
    """As-of lookup: the latest event at or before each event that satisfies ``cond``."""
    return neighbour(df, cond, by, ts, payload, chunk, name, False, strict)


def row_numbers(df: DataFrame, order: str, tie: str, width: int, name: str) -> DataFrame:
    """Number all rows 1, 2, ... by the long column ``order``, ties by ``tie``.

    Rows are numbered inside chunks of ``order`` and shifted by what lies before the
    chunk, so no task sees the whole table; the table of chunk sizes is itself scanned in
    runs of a thousand, twice over.
    """
    base = df.withColumn("_chunk", bucket_of(F.col(order), width))
    sizes = base.groupBy(F.col("_chunk").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    shift = running(sizes, [], "_at", 1000, {"_shift": ("sum", F.col("_n"), True)}, levels=3)
    shift = shift.select(F.col("_at").alias("_chunk"), F.coalesce("_shift", F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy("_chunk").orderBy(order, tie))
    numbered = base.withColumn("_local", local).join(shift, "_chunk")
    return numbered.select(*df.columns, (F.col("_local") + F.col("_shift")).alias(name))
