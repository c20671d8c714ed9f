"""Where matches and corrections go."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_matches(m: DataFrame, path: str, checkpoint: str | None = None):
    """Append matches as Parquet; a streaming table needs a checkpoint folder and returns
    its query."""
    if m.isStreaming:
        return (
            m.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    m.write.mode("append").parquet(path)


def write_changelog(log: DataFrame, path: str, revision: int | None = None) -> None:
    """Write changes; with a revision into its own folder, so that writing it again after
    a failure replaces it instead of doubling it."""
    if revision is None:
        log.write.mode("append").parquet(path)
    else:
        log.write.mode("overwrite").parquet(f"{path}/revision={revision}")
