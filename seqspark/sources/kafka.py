"""Kafka topics as event tables.  Needs the Kafka connector on the class path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scans import row_numbers


def kafka_options(servers: str, topics: Sequence[str], headers: bool = False) -> dict[str, str]:
    """Source options: from the earliest record; offsets live in the query checkpoint."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "includeHeaders": str(headers).lower(),
    }


def kafka_messages(raw: DataFrame, headers: bool = False) -> DataFrame:
    """Kafka rows as (kind, value, arrival_seq, ingest_ts, partition, offset, key[, headers]).

    Offsets order one partition only, so ``arrival_seq`` is (ingest time, topic, partition, offset): unique, and the
    order of arrival over all partitions.  :func:`number_arrivals` turns it into the long that running scans need.
    """
    extra = ["headers"] if headers else []
    order = F.struct(F.unix_micros("timestamp").alias("at"), "topic", "partition", "offset")
    return raw.select(
        F.col("topic").alias("kind"), F.col("value").cast("string").alias("value"),
        order.alias("arrival_seq"), F.col("timestamp").alias("ingest_ts"), "partition", "offset",
        F.col("key").cast("string").alias("key"), *extra,
    )


#: Rows of one micro-batch that a revision's range of numbers has room for.
BATCH_ROWS = 1 << 40


def number_arrivals(batch: DataFrame, revision: int = 0, chunk_us: int = 60_000_000) -> DataFrame:
    """The same rows with ``arrival_seq`` as a long: the revision's range plus the rank within the batch.

    Apply it to a micro-batch before the lateness gate or a running scan, e.g. in ``foreachBatch`` with its number.
    Later batches have larger numbers, and a batch that is repeated gets the same ones.  Ranks are taken inside spans
    of ingest time and shifted by what lies before, so no task sees the whole batch.
    """
    at = batch.withColumnRenamed("arrival_seq", "_order").withColumn("_at", F.col("_order")["at"])
    ranked = row_numbers(at, "_at", "_order", chunk_us, "_rank")
    number = F.col("_rank").cast("long") + F.lit(revision * BATCH_ROWS)
    return ranked.withColumn("arrival_seq", number).select(*batch.columns)


def read_kafka_events(
    spark: SparkSession, servers: str, topics: Sequence[str], headers: bool = False, streaming: bool = True
) -> DataFrame:
    """Subscribe to topics; pass the result to ``normalise(df, "kind")``.

    A stream orders arrivals by a struct until its micro-batches go through :func:`number_arrivals`; a batch is numbered.
    """
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").options(**kafka_options(servers, topics, headers)).load()
    messages = kafka_messages(raw, headers)
    return messages if streaming else number_arrivals(messages)


def replay_options(servers: str, topics: Sequence[str], start_ms: int, end_ms: int) -> dict[str, str]:
    """Batch options that read the records between two times."""
    options = kafka_options(servers, topics)
    del options["startingOffsets"]  # a time and an offset to start from exclude each other
    return {**options, "startingTimestamp": str(start_ms), "endingTimestamp": str(end_ms)}


def read_kafka_range(
    spark: SparkSession, servers: str, topics: Sequence[str], start_ms: int, end_ms: int, headers: bool = False
) -> DataFrame:
    """The records between two times, as a batch."""
    options = replay_options(servers, topics, start_ms, end_ms) | {"includeHeaders": str(headers).lower()}
    return number_arrivals(kafka_messages(spark.read.format("kafka").options(**options).load(), headers))


def replay_range(events: DataFrame, start: Column, end: Column, types: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Events with ``start <= ts <= end`` read again from an event table.

    The comparison is on the time column itself, so it prunes files and row groups.
    """
    out = events.filter((F.col(ts) >= start) & (F.col(ts) <= end))
    return out.filter(F.col("event_type").isin(*types)) if types else out


def with_topic(df: DataFrame, value: str = "value", default: str = "Abc") -> DataFrame:
    """Choose the topic from the shape of the JSON message."""
    def has(field):
        return F.get_json_object(value, f"$.{field}").isNotNull()

    topic = (
        F.when(has("fitbit"), "Fitbit").when(has("scale"), "Scale")
        .when(has("location"), "Locations").otherwise(default)
    )
    return df.withColumn("topic", topic)


def write_kafka(df: DataFrame, servers: str, value: str = "value", default: str = "Abc"):
    """Publish JSON messages, each to the topic of its kind."""
    out = with_topic(df, value, default).select("topic", F.col(value).alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
