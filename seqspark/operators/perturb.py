"""Disturb a table the way real streams are disturbed: disorder, delay, repeats.

The same row is always disturbed the same way for a given seed, on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import from_ticks, ticks
from ..plans.scans import row_numbers

# Modulus and multipliers of two well-known Lehmer generators.
MODULUS = 2_147_483_647
MULTIPLIERS = (48_271, 69_621)

# Displacement in places and its relative frequency.
DELAYS = (1, 2, 3, 5, 10, 20, 60)
WEIGHTS = (30, 20, 10, 5, 3, 2, 1)


def uniform(id: Column, seed: int, draw: int = 0) -> Column:
    """A repeatable number in [0, 1) for an integer id."""
    m, (a, b) = F.lit(MODULUS).cast("long"), MULTIPLIERS
    x = F.pmod(F.pmod(id.cast("long"), m) * a + (seed + 1) * b + draw * 1_000_003, m)
    # Squaring keeps different draws for one id apart; the products stay below 2^63.
    for _ in range(2):
        x = F.pmod(x * x + x * b + 11, m)
    return x / F.lit(float(MODULUS))


def pick(u: Column, values, weights) -> Column:
    """Map a uniform number to one of ``values`` by weight."""
    total, out = sum(weights), F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(u * total < sum(weights[: i + 1]), values[i]).otherwise(out)
    return out


def inject_disorder(
    df: DataFrame, prob: float, delays=DELAYS, weights=WEIGHTS, seed: int = 0, *,
    unit: int | None = None, ts: str = "ts", id: str = "event_id", chunk: int | None = None,
) -> DataFrame:
    """Add ``arrival_seq`` and ``out_of_order``: a share of the rows arrives later.

    A displaced row arrives ``delay * unit`` ticks after its time (default: one minute for
    timestamps, one for numeric times); rows arrive by (time + delay, id).
    """
    timestamp = "timestamp" in df.schema[ts].dataType.simpleString()
    unit = unit or (60_000_000 if timestamp else 1)
    moved = uniform(F.col(id), seed) < prob
    lag = F.when(moved, pick(uniform(F.col(id), seed, 1), list(delays), list(weights))).otherwise(0)
    out = df.withColumn("out_of_order", moved).withColumn("_at", ticks(df, ts) + lag.cast("long") * unit)
    return row_numbers(out, "_at", id, chunk or 1440 * unit, "arrival_seq").drop("_at")


def inject_delay(
    df: DataFrame, prob: float, lo: int, hi: int, seed: int = 0, *, unit: int | None = None,
    ts: str = "ts", id: str = "event_id",
) -> DataFrame:
    """Add ``ingest_ts``: the event time plus ``lo..hi`` units for a share of the rows
    (default unit: one second for timestamps, one for numeric times)."""
    timestamp = "timestamp" in df.schema[ts].dataType.simpleString()
    unit = unit or (1_000_000 if timestamp else 1)
    steps = F.floor(uniform(F.col(id), seed, 1) * (hi - lo + 1)) + lo
    lag = F.when(uniform(F.col(id), seed) < prob, steps).otherwise(0)
    return df.withColumn("ingest_ts", from_ticks(df, ts, ticks(df, ts) + lag.cast("long") * unit))


def inject_duplicates(df: DataFrame, prob: float, seed: int = 0, *, id: str = "event_id") -> DataFrame:
    """Repeat a share of the rows (``copy`` is 0 for the original, 1 for the repeat)."""
    again = uniform(F.col(id), seed) < prob
    copies = F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies))
