"""Event time as exact long ticks: microseconds for timestamps, the value itself otherwise."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import micros


def ticks(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    raise ValueError(f"time column {name} has type {kind.simpleString()}")


def from_ticks(df: DataFrame, name: str, tick: Column) -> Column:
    """Turn ticks back into the type column ``name`` has in ``df``."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(tick)
    if isinstance(kind, T.TimestampNTZType):
        wall = F.timestamp_micros(tick)
        return F.convert_timezone(None, F.lit("UTC"), wall.cast("timestamp_ntz"))
    return tick.cast(kind)


def duration_ticks(df: DataFrame, name: str, duration: timedelta | str | int) -> int:
    """A duration in the ticks of time column ``name``."""
    numeric = isinstance(df.schema[name].dataType, T.IntegralType)
    if isinstance(duration, (timedelta, str)):
        if numeric:
            raise ValueError(f"{name} is numeric: give the duration as a number")
        return micros(duration)
    if not numeric:
        raise ValueError(f"{name} is a timestamp: give the duration as timedelta or text")
    return int(duration)


def in_ms(df: DataFrame, name: str, tick: Column) -> Column:
    """Ticks of a time column as milliseconds; numeric time columns keep their own unit."""
    per = 1 if isinstance(df.schema[name].dataType, T.IntegralType) else 1000
    return tick / F.lit(float(per))


def bucket_of(tick: Column, width: int) -> Column:
    """Exact floor(tick / width) on longs."""
    w = F.lit(int(width)).cast("long")
    return F.call_function("div", tick - F.pmod(tick, w), w)
