"""Stored events and matches of a streaming job: a delta per revision, merged into snapshots per time bucket.

Layout of a store::

    events/revision=R/time_bucket=B     events of micro-batch R
    changes/revision=R/end_bucket=B     changelog of micro-batch R
    snapshots/events/gen=G/time_bucket=B, snapshots/matches/gen=G/end_bucket=B
    manifest/gen=G                      which generation holds each bucket, and the last revision it includes

A merge writes only the buckets that its deltas touch, under a new generation number, and then the manifest: until that
is committed, readers see the old generation and the old deltas, and a merge that is repeated after a failure writes the
same generation again.  What the manifest no longer names is deleted afterwards, or by the next merge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.time import bucket_of, duration_ticks, ticks
from ..operators.corrections import CORE, apply_changelog
from ..spec import PatternSpec

HOUR = 3_600_000_000
BUCKET = {"events": "time_bucket", "changes": "end_bucket", "matches": "end_bucket"}
ROWS_PER_FILE = 1_000_000


def bucket_width(events: DataFrame, spec: PatternSpec, ts: str | None = None) -> int:
    """Width of a folder of stored events: the window, for timestamps at least an hour."""
    name = ts or spec.ts
    width = max(1, duration_ticks(events, name, spec.within))
    timestamp = "timestamp" in events.schema[name].dataType.simpleString()
    return max(width, HOUR) if timestamp else width


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any file system that Spark can reach; none while it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders ``name=N``."""
    return sorted(int(x.split("=")[1]) for x in folders(spark, path) if x.startswith(f"{name}="))


@dataclass(frozen=True)
class Manifest:
    """``buckets[kind][bucket]`` is the generation that holds a bucket; revisions up to ``upto`` are merged.

    ``horizon`` is the newest event time among them.  One entry per live bucket: with expiry as many as the retention
    holds, without it one per window since the first event.
    """

    gen: int = -1
    upto: int = -1
    horizon: int | None = None
    buckets: dict[str, dict[int, int]] = field(default_factory=lambda: {"events": {}, "matches": {}})


def read_manifest(spark: SparkSession, store: str) -> Manifest:
    """The newest committed manifest."""
    done = [g for g in numbered(spark, f"{store}/manifest", "gen") if "_SUCCESS" in folders(spark, f"{store}/manifest/gen={g}")]
    if not done:
        return Manifest()
    buckets, facts = {"events": {}, "matches": {}}, {}
    for r in spark.read.parquet(f"{store}/manifest/gen={done[-1]}").collect():
        if r["kind"] in buckets:
            buckets[r["kind"]][r["bucket"]] = r["at"]
        else:
            facts[r["kind"]] = r["at"]
    return Manifest(done[-1], facts["upto"], facts["horizon"], buckets)


def write_manifest(spark: SparkSession, store: str, m: Manifest) -> None:
    rows = [(kind, b, g) for kind, held in m.buckets.items() for b, g in sorted(held.items())]
    rows += [("upto", None, m.upto), ("horizon", None, m.horizon)]
    table = spark.createDataFrame(rows, "kind string, bucket long, at long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/gen={m.gen}")


def _read(spark: SparkSession, base: str, paths: list[str], column: str, schema: StructType | None) -> DataFrame | None:
    if not paths:
        return None
    reader = spark.read.option("basePath", base)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*paths).withColumn(column, F.col(column).cast("long"))


def read_snapshot(
    spark: SparkSession, store: str, kind: str, m: Manifest, near: list[int] | None = None, schema: StructType | None = None
) -> DataFrame | None:
    """Merged rows of the given buckets (all if none are given); only their folders are listed."""
    held = m.buckets[kind]
    column, base = BUCKET[kind], f"{store}/snapshots/{kind}"
    wanted = held if near is None else [b for b in near if b in held]
    return _read(spark, base, [f"{base}/gen={held[b]}/{column}={b}" for b in wanted], column, schema)


def read_deltas(
    spark: SparkSession, store: str, kind: str, m: Manifest, before: int | None = None, near: list[int] | None = None,
    schema: StructType | None = None,
) -> DataFrame | None:
    """Rows (with ``revision``) of the revisions after the manifest, in the given buckets."""
    column, base = BUCKET[kind], f"{store}/{kind}"
    later = [r for r in numbered(spark, base, "revision") if r > m.upto and (before is None or r < before)]
    if schema is None:  # a revision without changes holds no file to take a schema from
        later = [r for r in later if any(x.startswith(f"{column}=") for x in folders(spark, f"{base}/revision={r}"))]
    out = _read(spark, base, [f"{base}/revision={r}" for r in later], column, schema)
    return out if out is None or near is None else out.where(F.col(column).isin(near))


def with_bucket(schema: StructType, column: str, revision: bool = True) -> StructType:
    """A stored table's schema: the rows and the folder names above them."""
    out = StructType([f for f in schema.fields if f.name not in (column, "revision")])
    return out.add("revision", "long").add(column, "long") if revision else out.add("gen", "long").add(column, "long")


def stored_matches(
    spark: SparkSession, store: str, spec: PatternSpec, before: int | None = None, near: list[int] | None = None
) -> DataFrame | None:
    """The folded matches of the given end buckets: their snapshot and the later changes."""
    m = read_manifest(spark, store)
    base = read_snapshot(spark, store, "matches", m, near)
    log = read_deltas(spark, store, "changes", m, before, near)
    if log is None:
        return None if base is None else base.select(*spec.keys, *CORE)
    return apply_changelog(base, log, spec.keys)


def clean(spark: SparkSession, store: str, m: Manifest) -> None:
    """Delete merged deltas and generations that the manifest does not name."""
    for kind in ("events", "changes"):
        for r in numbered(spark, f"{store}/{kind}", "revision"):
            if r <= m.upto:
                remove(spark, f"{store}/{kind}/revision={r}")
    for kind, held in m.buckets.items():
        base, live = f"{store}/snapshots/{kind}", {(g, b) for b, g in held.items()}
        used = {g for g, _ in live}
        for g in numbered(spark, base, "gen"):
            if g not in used:
                remove(spark, f"{base}/gen={g}")
                continue
            for b in numbered(spark, f"{base}/gen={g}", BUCKET[kind]):
                if (g, b) not in live:
                    remove(spark, f"{base}/gen={g}/{BUCKET[kind]}={b}")
    for g in numbered(spark, f"{store}/manifest", "gen"):
        if g < m.gen:
            remove(spark, f"{store}/manifest/gen={g}")


def write_buckets(rows: DataFrame, column: str, path: str, rows_per_file: int) -> None:
    """One file per bucket, more where a bucket holds more rows; a full bucket is dealt to as many tasks."""
    sizes = rows.groupBy(column).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    kind = F.xxhash64(*[c for c in rows.columns if c != column])
    dealt = rows.join(sizes, column).withColumn("_file", F.pmod(kind, F.col("_files"))).repartition(column, "_file")
    dealt.drop("_file", "_files").write.mode("overwrite").partitionBy(column).parquet(path)


def compact(
    spark: SparkSession, store: str, spec: PatternSpec, before: int, expire: bool = False, rows_per_file: int = ROWS_PER_FILE
) -> Manifest:
    """Merge the revisions below ``before`` into the snapshots; with ``expire`` drop what can no longer change.

    Matches in buckets that ended a window before the newest event, and events in buckets that ended two windows
    before it, leave the store.  :func:`seqspark.streaming.store.correct` refuses events older than one window then,
    so every window that can still be asked for is whole.
    """
    m = read_manifest(spark, store)
    clean(spark, store, m)
    new_events = read_deltas(spark, store, "events", m, before)
    if new_events is None:
        return m
    gen, upto = m.gen + 1, max(r for r in numbered(spark, f"{store}/events", "revision") if r < before)
    width, window = bucket_width(new_events, spec), duration_ticks(new_events, spec.ts, spec.within)
    newest = new_events.agg(F.max(ticks(new_events, spec.ts))).first()[0]
    horizon = newest if m.horizon is None else max(newest, m.horizon)
    keep_from = {"events": None, "matches": None}
    if expire:
        keep_from = {kind: (horizon - n * window) // width for kind, n in (("events", 2), ("matches", 1))}

    def live(b: int, kind: str) -> bool:
        return keep_from[kind] is None or b >= keep_from[kind]

    buckets = {kind: {b: g for b, g in held.items() if live(b, kind)} for kind, held in m.buckets.items()}
    log = read_deltas(spark, store, "changes", m, before)
    for kind, deltas in (("events", new_events), ("matches", log)):
        if deltas is None:
            continue
        column = BUCKET[kind]
        touched = [r[0] for r in deltas.select(column).distinct().collect() if live(r[0], kind)]
        if not touched:
            continue
        deltas = deltas.where(F.col(column).isin(touched))
        old = read_snapshot(spark, store, kind, m, touched)
        if kind == "matches":
            rows = apply_changelog(old, deltas, spec.keys)
            rows = rows.withColumn(column, bucket_of(ticks(rows, "end_ts"), width))
        else:
            rows = deltas.drop("revision")
            rows = rows if old is None else rows.unionByName(old.drop("gen"))
        write_buckets(rows, column, f"{store}/snapshots/{kind}/gen={gen}", rows_per_file)
        # a bucket whose matches are all gone has no folder
        left = set(numbered(spark, f"{store}/snapshots/{kind}/gen={gen}", column))
        buckets[kind] = {b: g for b, g in buckets[kind].items() if b not in touched} | {b: gen for b in touched if b in left}
    out = Manifest(gen, upto, horizon, buckets)
    write_manifest(spark, store, out)
    clean(spark, store, out)
    return out
