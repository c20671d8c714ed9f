"""Extrema over a sliding window, without an array per window and without a join of pairs.

Time is cut into blocks as wide as the window, so ``[x - W, x]`` is the end of one block and the beginning of the next:
a running extremum backwards from the block's end to ``x - W`` and one forwards from the block's start to ``x``.  Both are
the two-level scans of ``scans``, so a block that holds a burst is split into chunks like a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from .scans import AGGREGATES, running


def window_extrema(
    rows: DataFrame, ends: DataFrame, by: list[str], within: int, chunk: int, measures: dict[str, tuple[str, Column]],
    *, at: str = "_t", id: str = "end_id", strict: bool = False,
) -> DataFrame:
    """Per end the ``min``/``max`` of values of the rows of its key with a time in ``[x - within, x]``.

    ``rows`` and ``ends`` have the keys and the long column ``at``; ``ends`` a unique ``id`` per key.  With ``strict``
    rows at the end's own time are left out.  Ends without rows in their window get nulls.
    """
    width = max(1, within)
    values = rows.select(*by, at, *[v.alias(n) for n, (_, v) in measures.items()])
    empty = [F.lit(None).cast(values.schema[n].dataType).alias(n) for n in measures]
    values = values.withColumn(id, F.lit(None).cast(ends.schema[id].dataType))
    parts = []
    for back in (False, True):
        place = F.col(at) - width if back else F.col(at)
        probes = ends.select(*by, place.alias(at), *empty, id)
        both = values.unionByName(probes).withColumn("_block", bucket_of(F.col(at), width))
        scans = {f"_{n}": (kind, F.col(n), strict and not back) for n, (kind, _) in measures.items()}
        out = running(both, [*by, "_block"], at, min(chunk, width), scans, reverse=back).where(F.col(id).isNotNull())
        parts.append(out.select(*by, id, *[F.col(f"_{n}").alias(n) for n in measures]))
    return parts[0].unionByName(parts[1]).groupBy(*by, id).agg(*[AGGREGATES[kind](n).alias(n) for n, (kind, _) in measures.items()])
