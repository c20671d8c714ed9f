"""Fit a pattern's plan to the busiest key of a table."""

from __future__ import annotations

from dataclasses import replace as with_fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from ..plans.base import prepare
from ..spec import PatternSpec


def fit_to_data(events: DataFrame, spec: PatternSpec, rows_per_task: int = 1_000_000) -> PatternSpec:
    """Choose ``chunk`` and ``salt`` so that no task gets much more than ``rows_per_task``
    rows of one key.

    Reads the keys and times once, combined before the shuffle; a single number comes back
    to the driver.  The matches do not change, only how the work is cut.
    """
    p = prepare(events, spec)
    width = max(1, p.within)
    sizes = p.df.groupBy(*spec.keys, bucket_of(F.col("_e")["t"], width).alias("_k")).count()
    busiest = sizes.agg(F.max("count")).first()[0] or 0
    over = -(-busiest // rows_per_task)
    if over <= 1:
        return spec
    chunk = max(1, width // over)
    numeric = "timestamp" not in events.schema[spec.ts].dataType.simpleString()
    return with_fields(spec, chunk=chunk if numeric else f"{chunk} us", salt=over)
