"""Matching on a stream with an event table and a changelog on shared storage.

Every micro-batch appends its events, finds the ends they can change, recomputes the
matches of those ends with the batch plans and writes the difference as the next revision.
A batch that runs again after a failure rewrites its own revision, so the folded changelog
always equals the batch answer over the events seen.  Old revisions are merged into
snapshots (see ``snapshots``), so what a batch reads depends on its own time buckets and on
the revisions since the last merge, not on the age of the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, ticks
from ..operators.corrections import CORE, apply_changelog, diff_matches, expire_matches
from ..operators.lateness import affected_ends
from ..operators.match import match_at_end
from ..operators.near import near_ends, slim
from ..plans.base import relevant_events
from ..spec import PatternSpec
from .snapshots import bucket_width, compact, read_deltas, read_manifest, read_snapshot, remove, stored_matches, with_bucket


def current_matches(spark: SparkSession, store: str, spec: PatternSpec) -> DataFrame:
    """The matches after all corrections so far (with expiry: those still in the store)."""
    found = stored_matches(spark, store, spec)
    if found is None:
        raise ValueError(f"no matches were stored in {store}")
    return found


def live_matches(spark: SparkSession, store: str, spec: PatternSpec) -> DataFrame:
    """The matches that ended at most one window before the newest stored event."""
    found, m = current_matches(spark, store, spec), read_manifest(spark, store)
    newest = m.horizon
    later = read_deltas(spark, store, "events", m)
    if later is not None:
        latest = later.agg(F.max(ticks(later, spec.ts))).first()[0]
        newest = latest if newest is None else max(latest, newest)
    return expire_matches(found, F.lit(newest), spec.within)


def correct(
    batch: DataFrame, revision: int, spec: PatternSpec, store: str, with_correction: bool = True,
    gate: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]] | None = None, expire: bool = False,
) -> None:
    """Take in one batch of events as ``revision`` (safe to repeat).

    With ``expire`` events more than one window older than the newest merged event go to
    ``store/refused``: their window may have left the store.
    """
    batch = batch.persist()  # its source is read once, however often the plans below look at it
    try:
        _correct(batch, revision, spec, store, with_correction, gate, expire)
    finally:
        batch.unpersist()
        if hasattr(gate, "release"):
            gate.release()


def written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _correct(batch, revision, spec, store, with_correction, gate, expire) -> None:
    spark = batch.sparkSession
    if gate is not None:
        batch, dropped = gate(batch, revision)
        dropped.write.mode("overwrite").parquet(f"{store}/dropped/revision={revision}")
    used = batch if spec.policy == "contiguous" else relevant_events(batch, spec)
    used = used.where(F.col(spec.ts).isNotNull())
    width, unique = bucket_width(used, spec), [*spec.keys, spec.id]
    fresh = used.withColumn("time_bucket", bucket_of(ticks(used, spec.ts), width))
    manifest = read_manifest(spark, store)
    if expire and manifest.horizon is not None:
        in_time = ticks(used, spec.ts) >= manifest.horizon - duration_ticks(used, spec.ts, spec.within)
        refused = fresh.where(~in_time).drop("time_bucket").dropDuplicates(unique)
        refused.write.mode("overwrite").parquet(f"{store}/refused/revision={revision}")
        fresh = fresh.where(in_time)
    # one entry per window that the batch touches
    touched = sorted(r[0] for r in fresh.select("time_bucket").distinct().collect())
    if not touched:
        return
    # Ends that can change lie up to one window ahead, their events up to three back. Only the
    # buckets around the batch's own are read, so one stray old event costs its few buckets.
    near = sorted({b + k for b in touched for k in range(-3, 2)})
    columns = [c for c in fresh.columns if c != "time_bucket"]
    parts = [
        read_snapshot(spark, store, "events", manifest, near, with_bucket(fresh.schema, "time_bucket", revision=False)),
        read_deltas(spark, store, "events", manifest, revision, near, with_bucket(fresh.schema, "time_bucket")),
    ]
    fresh, seen = fresh.dropDuplicates(unique), None
    for part in parts:
        if part is not None:
            part = part.select(*columns, "time_bucket")
            seen = part if seen is None else seen.unionByName(part)
    if seen is not None:
        known = seen.select("time_bucket", *unique)
        fresh = fresh.join(known, ["time_bucket", *unique], "left_anti")
    here = f"{store}/events/revision={revision}"
    fresh.write.mode("overwrite").partitionBy("time_bucket").parquet(here)
    fresh = spark.read.schema(fresh.schema).parquet(here)
    events, used_by = slim(fresh.select(*columns), spec)
    late = events
    if seen is not None:
        events = events.unionByName(slim(seen.select(*columns), spec)[0])
    # The plans below read both several times: tables of as many files as their rows need, where a cache keeps all
    # shuffle partitions of every batch.
    work = f"{store}/work/revision={revision}"
    ends = written(affected_ends(late, events, used_by), f"{work}/ends")
    around = written(near_ends(events, ends, used_by), f"{work}/around")
    new = match_at_end(around, used_by, ends, near=True).select(*spec.keys, *CORE)

    ends_near = sorted({b + k for b in touched for k in (-1, 0, 1)})
    old = stored_matches(spark, store, spec, revision, ends_near)
    old = new.limit(0) if old is None else old.join(ends.select("end_id").distinct(), "end_id", "left_semi")
    changes = diff_matches(
        old, new, spec.keys, first_plain=not spec.positive[0].kleene, with_correction=with_correction
    )
    changes = changes.withColumn("end_bucket", bucket_of(ticks(changes, "end_ts"), width))
    changes.write.mode("overwrite").partitionBy("end_bucket").parquet(f"{store}/changes/revision={revision}")
    remove(spark, work)


def stream_match_batch(
    sdf: DataFrame, spec: PatternSpec, store: str, checkpoint: str, with_correction: bool = True,
    gate: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]] | None = None, compact_every: int | None = 20, expire: bool = False,
):
    """Run :func:`correct` on every micro-batch; returns the started query.

    ``gate`` may split a batch, given its revision, into (kept, dropped), e.g. a ``LatenessGate``;
    dropped events go to ``store/dropped``.  Before every ``compact_every``-th batch the revisions
    that are committed are merged (see ``snapshots.compact``); ``expire`` then lets old buckets go.
    """

    def take(batch: DataFrame, number: int) -> None:
        # earlier batches are committed and never run again, so a merge holds no revision that may
        if compact_every and number and number % compact_every == 0:
            compact(batch.sparkSession, store, spec, number, expire)
        correct(batch, number, spec, store, with_correction, gate, expire)

    return (
        sdf.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
