"""Rows that are too late for a job with a watermark, kept instead of lost."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import micros


def stream_dropped(sdf: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", ts: str = "ts"):
    """Write the rows that ``stream_match`` and ``stream_sequence_append`` with this ``delay`` leave out to ``path/late``.

    Run it on the same input beside them. The limit of a micro-batch is the latest time of the batches before it, less
    the delay, as for their watermark; one row per batch with its latest time is kept in ``path/latest``. A batch that
    is repeated after a failure reads the state before it and writes its own folders again. Returns the started query.
    """
    wait = micros(delay)
    if wait % 1000:
        raise ValueError("a watermark counts whole milliseconds")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        t = F.unix_micros(F.col(ts).cast("timestamp"))
        try:
            before = spark.read.schema("at long, revision long").parquet(f"{path}/latest").where(F.col("revision") < number)
            latest = before.agg(F.max("at")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            latest = None
        limit = None if latest is None else latest // 1000 * 1000 - wait
        late = batch.where(F.lit(False) if limit is None else t <= limit)
        late.write.mode("overwrite").parquet(f"{path}/late/revision={number}")
        batch.agg(F.max(t).alias("at")).where("at is not null").write.mode("overwrite").parquet(f"{path}/latest/revision={number}")

    return (
        sdf.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
