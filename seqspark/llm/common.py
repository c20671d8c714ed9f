"""Helpers of the corpus operators: scratch tables, keys that spread, running sums in two levels."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return shared.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    Cuts the lineage, makes row numbers and partition numbers part of the data, and survives lost executors.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: File names that are broadcast at most.
FILES = 100_000


def with_row(docs: DataFrame, reread: bool, out: str = "__row") -> DataFrame:
    """Add a row's number, the same each time the result is read, however its files are split among tasks.

    ``reread`` says that ``docs`` is read from Parquet files, with columns selected or added at most: the number is the
    rank of its file's name and the reader's own row index. The names come to the driver and are a broadcast, up to FILES
    of them, counted. A table of more files, and any other input, is written once together with its numbers.
    """
    spark = docs.sparkSession
    if reread:
        meta = docs.metadataColumn("_metadata")
        names = docs.select(meta["file_path"].alias("__file")).distinct().limit(FILES + 1).collect()
        if len(names) <= FILES:
            ranks = [(name, k) for k, name in enumerate(sorted(r[0] for r in names))]
            ranks = F.broadcast(spark.createDataFrame(ranks, "__file string, __rank long"))
            placed = docs.select("*", meta["file_path"].alias("__file"), meta["row_index"].alias("__at")).join(ranks, "__file")
            return placed.withColumn(out, F.shiftleft("__rank", 40) + F.col("__at")).drop("__file", "__rank", "__at")
    return keep(docs.withColumn(out, F.monotonically_increasing_id()), "documents")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside: whole texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def values(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table made on the driver as one literal; callers state why its size is bounded."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return spark.range(1).select(F.explode(text).alias("r")).select("r.*")


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated once per row.

    A generator of one row: filters and later expressions are not pushed into it, so an array that lambdas read is
    not computed again for each of its elements.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread_bits(spark: SparkSession) -> int:
    """Bits that cut one group into about as many ranges as a shuffle has partitions, at most 2^12."""
    return min(12, max(1, math.ceil(math.log2(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))))))


def running(df: DataFrame, group: str, order: str, tie: str, out: str, weight: str | None = None) -> DataFrame:
    """Add the sum of ``weight`` (1 if none) over the earlier rows of a row's group, exactly, in two levels.

    ``order`` is a uniform 64-bit hash: its top bits cut every group, however large, into ranges that are summed
    alone; one row per (group, range) carries the offsets. ``group`` must not be null. ``df`` is read twice and must
    give the same rows each time (see keep). Without weights this numbers the rows of a group from 0, gapless.
    """
    bits = spread_bits(df.sparkSession)
    cut = df.withColumn("__range", F.shiftright(F.col(order), 64 - bits).cast("int"))
    unit = F.col(weight) if weight else F.lit(1).cast("long")
    sums = cut.groupBy(group, "__range").agg(F.sum(unit).alias("__range_sum"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__range_before", F.coalesce(F.sum("__range_sum").over(before), F.lit(0).cast("long"))).drop("__range_sum")
    inner = Window.partitionBy(group, "__range").orderBy(order, tie)
    if weight:
        own = F.coalesce(F.sum(unit).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    else:
        own = F.row_number().over(inner).cast("long") - 1
    joined = cut.withColumn("__range_own", own).join(sums, [group, "__range"])
    return joined.withColumn(out, F.col("__range_before") + F.col("__range_own")).drop("__range_before", "__range_own", "__range")


def without_spaces(text: Column) -> Column:
    """The text without its six kinds of white space; plain replacements stay in generated code."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Array of the words of a text; null or blank text has none."""
    some = F.length(without_spaces(F.coalesce(text, F.lit("")))) > 0
    trimmed = F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(some, F.split(trimmed, f"{SPACE_CLASS}+")).otherwise(F.array().cast("array<string>"))


def replace_columns(df: DataFrame, new: list[str]) -> DataFrame:
    """Drop input columns that a result column of the same name (in any case) replaces."""
    lower = {c.lower() for c in new}
    return df.select([df[c] for c in df.columns if c.lower() not in lower])
