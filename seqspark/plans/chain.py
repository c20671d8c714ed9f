"""Chains of "the next event that ..." lookups in one shuffle.

Rows are scanned per (key, time chunk).  What a chunk cannot answer itself is filled from
a table with one row per (key, chunk) that knows, for each hop, the first target of the
chunks to come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from .base import both
from .scans import carry_over


def next_chain(df: DataFrame, by, width: int, hops: list[Column], *, ties: bool = False, levels: int = 2) -> DataFrame:
    """Add ``hop0``: the next event for which ``hops[0]`` holds, with its own field
    ``nxt``: the next event after it for which ``hops[1]`` holds, and so on.

    ``df`` has the keys and the struct ``_e`` (t, id, ...).  Later means a larger ``t``;
    with ``ties`` it means later in (t, id) order.
    """
    last = len(hops) - 1
    keys = [*by, "_chunk"]
    rows = df.withColumn("_chunk", bucket_of(F.col("_e")["t"], width)).withColumn("_t", F.col("_e")["t"])
    per_chunk = W.partitionBy(*keys)
    if ties:
        later = per_chunk.orderBy(F.col("_t").desc(), F.col("_e")["id"].desc()).rowsBetween(
            W.unboundedPreceding, -1
        )
    else:
        later = per_chunk.orderBy(F.col("_t").desc()).rangeBetween(W.unboundedPreceding, -1)

    def target(i):
        event = F.col("_e") if i == last else F.col("_e").withField("nxt", F.col(f"_n{i + 1}"))
        return F.when(hops[i], event)

    local = rows
    for i in range(last, -1, -1):
        local = local.withColumn(f"_n{i}", F.min(target(i)).over(later))

    def resolve(found, i, ahead):
        if i == last:
            return F.coalesce(found, ahead(i))
        whole = found.withField("nxt", resolve(found["nxt"], i + 1, ahead))
        return F.when(found.isNull(), ahead(i)).otherwise(whole)

    chunks = local.groupBy(*keys).agg(*[F.min(target(i)).alias(f"_h{i}") for i in range(last + 1)])
    for i in range(last, -1, -1):
        head = F.col(f"_h{i}")
        if i < last:
            rest = resolve(head["nxt"], i + 1, lambda j: F.col(f"_c{j}"))
            head = F.when(head.isNotNull(), head.withField("nxt", rest))
        # The nearest head ahead is the smallest one: heads sort by time.
        chunks = carry_over(chunks, by, {f"_c{i}": ("min", head)}, True, levels)

    carried = chunks.select(*[F.col(k).alias(f"_by_{k}") for k in keys], *[f"_c{i}" for i in range(last + 1)])
    joined = local.join(carried, both([F.col(k) == F.col(f"_by_{k}") for k in keys]))
    whole = resolve(F.col("_n0"), 0, lambda j: F.col(f"_c{j}"))
    return joined.select(*df.columns, whole.alias("hop0"))
