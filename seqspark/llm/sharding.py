"""Uniform shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, replace_columns, running, values
from .draws import even, matrix

#: Bound of the matrix that is drawn on the driver and broadcast: at most so many rows, one column per shard.
MAX_PARTS = 4096


def uniform_shards(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Deal all rows into ``shards`` shards whose sizes differ by one at most, uniformly at random.

    1. Rows are numbered and written once; a part is an input partition (folded to MAX_PARTS).
    2. The part-to-shard counts are drawn exactly: multivariate hypergeometric rows against what each shard still
       takes. The matrix has at most MAX_PARTS x shards counts.
    3. Each part is permuted locally and cut by its row of the matrix; rows go to their shard.
    4. Each shard is permuted again: ``slot`` is a row's place there, gapless from 0, numbered in two levels, so no
       task holds a whole shard.

    Returns the input columns with ``shard`` int and ``slot`` long (input columns of these names are replaced). Null
    ids or texts, ties and repeated rows are rows like any others, dealt by row number; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = replace_columns(docs, ["shard", "slot", "__row", "__part", "__mix", "__rank", "__ends"])
    rows = keep(
        docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(
            "__part", F.pmod(F.spark_partition_id(), F.lit(MAX_PARTS)).cast("int")
        ),
        "shard-rows",
    )
    counts = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())
    sizes = even(sum(n for _, n in counts), shards)
    drawn = matrix(random.Random(seed), [n for _, n in counts], sizes)
    ends = []
    for (part, _), row in zip(counts, drawn, strict=True):
        total = 0
        ends.append({"__part": part, "__ends": [total := total + n for n in row]})
    cut = values(spark, ends, "__part int, __ends array<bigint>")

    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), "__row"), "__row")
    dealt = (
        rows.withColumn("__rank", F.row_number().over(local).cast("long") - 1)
        .join(F.broadcast(cut), "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
        .withColumn("__mix", F.xxhash64(F.lit(seed + 1), "__row"))
        .drop("__ends", "__rank", "__part")
    )
    return running(dealt, "shard", "__mix", "__row", "slot").select(*docs.columns, "shard", "slot")
