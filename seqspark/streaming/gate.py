"""The lateness gate on a live stream: its running state goes from micro-batch to micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import ticks
from ..operators.lateness import LATE, adaptive_threshold, classify_lateness, discard_too_late, lateness_score
from .snapshots import numbered, remove


class LatenessGate:
    """Splits micro-batches into (kept, dropped) as ``adaptive_threshold`` splits the whole arrivals.

    The state, one row per source and type with its latest time and one per type with the sum and number of its late
    scores, is written to ``path`` with every revision, merged with the one before: a revision that is repeated after a
    failure starts from the same state, and the cut into micro-batches does not change any decision.
    """

    def __init__(
        self, sources: DataFrame, within: timedelta | str | int, path: str, factor: float = 1.0, a: float = 1.0, c: float = 0.0,
        by: Sequence[str] = ("source", "event_type"), types: Sequence[str] = ("event_type",), ts: str = "ts",
        order: str = "arrival_seq", chunk: int = 1_000_000,
    ):
        self.sources, self.within, self.path, self.factor, self.a, self.c = sources, within, path, factor, a, c
        self.by, self.types, self.ts, self.order, self.chunk = list(by), list(types), ts, order, chunk
        self.cached: DataFrame | None = None

    def state(self, spark: SparkSession, name: str, revision: int) -> DataFrame | None:
        """The last state before a revision; None before the first.

        Older states are deleted: a repeated revision starts from the same one, and only the newest can be repeated.
        """
        held = [r for r in numbered(spark, f"{self.path}/{name}", "revision") if r < revision]
        for r in held[:-2]:
            remove(spark, f"{self.path}/{name}/revision={r}")
        return spark.read.parquet(f"{self.path}/{name}/revision={held[-1]}") if held else None

    def release(self) -> None:
        """Free the cached decisions of the last batch, once both of its parts are written."""
        if self.cached is not None:
            self.cached.unpersist()
            self.cached = None

    def __call__(self, batch: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
        spark = batch.sparkSession
        self.release()
        high, scores = self.state(spark, "latest", revision), self.state(spark, "scores", revision)
        judged = classify_lateness(batch, self.sources, self.by, ts=self.ts, order=self.order, chunk=self.chunk, state=high)
        judged = lateness_score(judged, self.within, self.a, 0.0, self.c, ts=self.ts)
        judged = adaptive_threshold(judged, self.factor, self.types, order=self.order, chunk=self.chunk, state=scores)
        self.cached = judged.persist()

        late = F.col("status") == LATE
        now_high = batch.groupBy(*self.by).agg(F.max(ticks(batch, self.ts)).alias("latest"))
        now_scores = judged.where(late).groupBy(*self.types).agg(F.sum("score").alias("total"), F.count("*").alias("n"))
        if high is not None:
            now_high = now_high.unionByName(high).groupBy(*self.by).agg(F.max("latest").alias("latest"))
        if scores is not None:
            now_scores = now_scores.unionByName(scores).groupBy(*self.types).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        now_high.write.mode("overwrite").parquet(f"{self.path}/latest/revision={revision}")
        now_scores.write.mode("overwrite").parquet(f"{self.path}/scores/revision={revision}")
        return discard_too_late(judged)


def stream_gate(sdf: DataFrame, gate: LatenessGate, path: str, checkpoint: str):
    """Write what the gate keeps to ``path/kept`` and drops to ``path/dropped``; returns the started query."""

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in zip(("kept", "dropped"), gate(batch, number)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/revision={number}")
        gate.release()
        batch.unpersist()

    return sdf.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
