"""Query registry and what most queries share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scans import row_numbers
from ..functions.time import ticks
from ..spec import PatternSpec, Step

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its equivalent."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def scratch(spark: SparkSession) -> str:
    """A new folder on storage all executors share: below the checkpoint folder, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/seq-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows from a new table on shared storage: what several plans read is made once."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def A(**kw) -> Step:
    return Step("a", "event_type = 'view'", **kw)


def B(**kw) -> Step:
    return Step("b", "event_type = 'click'", **kw)


def C(**kw) -> Step:
    return Step("c", "event_type = 'purchase'", **kw)


def N() -> Step:
    return Step("n", "event_type = 'error'", negated=True)


def pattern(*steps: Step, days: int = 3, **kw) -> PatternSpec:
    return PatternSpec(steps, within=f"{days} d", partition_by=["user_id"], **kw)


def ids(col="event_ids"):
    return F.concat_ws(",", F.transform(col, lambda e: e.cast("string"))).alias("ids")


def flat(m: DataFrame, *more) -> DataFrame:
    """The comparable part of a match table."""
    return m.select("user_id", "start_ts", "end_ts", "end_id", F.col("n_events").cast("long"), ids(), *more)


# view, click and purchase events as a, b and c
ABC = """a AS (SELECT * FROM events WHERE event_type = 'view'),
b AS (SELECT * FROM events WHERE event_type = 'click'),
c AS (SELECT * FROM events WHERE event_type = 'purchase')"""

# one row per match from (x.user_id, start_ts, end_ts, end_id, event id list l)
FLAT = """SELECT user_id, start_ts, end_ts, end_id, CAST(len(l) AS BIGINT) AS n_events,
array_to_string(CAST(l AS VARCHAR[]), ',') AS ids FROM m"""

DELAY = "CASE WHEN event_id % 5 = 0 THEN (event_id * 7919) % 600 ELSE 0 END"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a source and an order of arrival: every fifth event comes late."""
    e = events(spark, folder).withColumn("source", F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")))
    at = ticks(e, "ts") + F.expr(DELAY) * 60_000_000
    return row_numbers(e.withColumn("_at", at), "_at", "event_id", 86_400_000_000, "arrival_seq").drop("_at")


ARR = f"""arr AS (SELECT *, 'src' || CAST(user_id % 3 AS VARCHAR) AS source, row_number() OVER (
  ORDER BY ts + to_minutes({DELAY}), event_id) AS arrival_seq FROM events)"""
