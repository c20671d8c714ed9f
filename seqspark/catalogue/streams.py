"""Streaming jobs over the event table, compared with the batch answer.

Each job reads the events as a file stream, in arrival order, until nothing is left.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import accuracy_under_disorder, apply_changelog, match
from ..sources import write_changelog, write_matches
from ..streaming import (
    LatenessGate,
    current_matches,
    live_matches,
    stream_dropped,
    stream_gate,
    stream_match,
    stream_match_batch,
    stream_sequence_append,
)
from .events import disorder
from .late import LATE, rates
from .matching import COMPACT, MAXIMAL, any_sql, next_sql
from .registry import ARR, A, B, C, arrivals, events, flat, pattern, query, scratch

PORTIONS, FILES, ROWS_PER_FILE = 3, 4, 250_000


@contextmanager
def arrived(spark, d):
    """The events in arrival order, kept while their portions are written."""
    rows = arrivals(spark, d).withColumn("ts", F.to_timestamp("ts")).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def portions_stream(spark, rows, path, portions, of=range):
    """One write of FILES files (more where they would be large) per portion; a stream reads a portion at a time."""
    size = rows.count() // portions + 1
    files = max(FILES, -(-size // ROWS_PER_FILE))
    portion = F.floor((F.col("arrival_seq") - 1) / size)
    for n in of(portions):
        rows.where(portion == n).repartition(files).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def event_stream(spark, d, path, portions=PORTIONS):
    with arrived(spark, d) as rows:
        return portions_stream(spark, rows, path, portions)


def finished(query):
    query.awaitTermination()
    return query


def batch_store(spark, d, spec):
    path = scratch(spark)
    job = stream_match_batch(event_stream(spark, d, path), spec, f"{path}/store", f"{path}/checkpoint")
    finished(job)
    m = current_matches(spark, f"{path}/store", spec)
    return flat(m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}))


@query("stream_match_batch_any", any_sql(3))
def q_store_any(spark, d):
    return batch_store(spark, d, pattern(A(), B(), C()))


@query("stream_match_batch_next", next_sql(3))
def q_store_next(spark, d):
    return batch_store(spark, d, pattern(A(), B(), C(), policy="next"))


@query("stream_match_batch_maximal", MAXIMAL)
def q_store_maximal(spark, d):
    return batch_store(spark, d, pattern(A(), B(kleene=True), C(), mode="maximal"))


@query("stream_match_batch_compact", COMPACT)
def q_store_compact(spark, d):
    return batch_store(spark, d, pattern(A(), B(kleene=True), C(), mode="maximal_compact"))


def restarted_store(spark, d, spec, expire):
    """Six micro-batches, merged before every second one, by two runs of the job over one store."""
    path = scratch(spark)
    with arrived(spark, d) as rows:
        for half in (range(3), range(3, 6)):
            stream = portions_stream(spark, rows, path, 6, lambda n, half=half: half)
            finished(stream_match_batch(stream, spec, f"{path}/store", f"{path}/checkpoint", compact_every=2, expire=expire))
    return f"{path}/store"


@query("stream_store_compacted", MAXIMAL)
def q_store_compacted(spark, d):
    spec = pattern(A(), B(kleene=True), C(), mode="maximal")
    m = current_matches(spark, restarted_store(spark, d, spec, False), spec)
    return flat(m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}))


@query(
    "stream_store_expired",
    f"SELECT * FROM ({any_sql(3)}) WHERE end_ts >= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click', 'purchase')) - INTERVAL 3 DAY",
)
def q_store_expired(spark, d):
    """What is left when events go after two windows and matches after one: those of the last window, all of them right."""
    spec = pattern(A(), B(), C())
    m = live_matches(spark, restarted_store(spark, d, spec, True), spec)
    return flat(m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}))


def keyed(spark, d, spec):
    path = scratch(spark)
    log = stream_match(event_stream(spark, d, path), spec, delay="1 day")

    def keep(batch, number):
        write_changelog(batch, f"{path}/log", number)

    job = log.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
    finished(job.trigger(availableNow=True).start())
    m = apply_changelog(None, spark.read.parquet(f"{path}/log"), spec.keys)
    return flat(m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}))


@query("stream_match_maximal", MAXIMAL)
def q_keyed_maximal(spark, d):
    return keyed(spark, d, pattern(A(), B(kleene=True), C(), mode="maximal"))


@query("stream_match_next", next_sql(3))
def q_keyed_next(spark, d):
    return keyed(spark, d, pattern(A(), B(), C(), policy="next"))


@query(
    "stream_match_dropped",
    f"""WITH {ARR}, cut AS (SELECT *, (arrival_seq - 1) // (SELECT count(*) // {PORTIONS} + 1 FROM events) AS part FROM arr),
    latest AS (SELECT part, max(ts) AS ts FROM cut GROUP BY part)
    SELECT event_id, ts FROM cut c WHERE ts <= (SELECT date_trunc('milliseconds', max(l.ts)) FROM latest l WHERE l.part < c.part)
    - INTERVAL 2 HOUR""",
)
def q_dropped(spark, d):
    """What a keyed job with a delay of two hours leaves out."""
    path = scratch(spark)
    finished(stream_dropped(event_stream(spark, d, path), f"{path}/side", f"{path}/checkpoint", "2 hours"))
    late = spark.read.parquet(f"{path}/side/late")
    return late.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


for side, test in (("kept", "accepted"), ("dropped", "NOT accepted")):

    @query(f"stream_gate_{side}", f"WITH {LATE} SELECT event_id, status FROM ok WHERE {test}")
    def q_gate(spark, d, side=side):
        """The gate's decisions on the live arrivals, against those on all arrivals at once."""
        path = scratch(spark)
        gate = LatenessGate(rates(spark), "3 d", f"{path}/gate", 1.02, 1.0, 2.0, chunk=1000)
        finished(stream_gate(event_stream(spark, d, path), gate, f"{path}/out", f"{path}/checkpoint"))
        return spark.read.parquet(f"{path}/out/{side}").select("event_id", "status")


@query("stream_sequence_append", any_sql(3))
def q_append(spark, d):
    path = scratch(spark)
    found = stream_sequence_append(event_stream(spark, d, path), pattern(A(), B(), C()), delay="1 day")
    finished(write_matches(found, f"{path}/matches", f"{path}/checkpoint"))
    m = spark.read.parquet(f"{path}/matches")
    return flat(m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}))


@query("write_matches", any_sql(3))
def q_write(spark, d):
    path = scratch(spark)
    write_matches(match(events(spark, d), pattern(A(), B(), C())), path)
    return flat(spark.read.parquet(path))


LEVELS = (0.2, 0.7)


def accuracy_sql() -> str:
    """Per level and query: the matches of every portion so far against the final ones."""
    sides = {"any": any_sql(1), "next": next_sql(1)}
    ctes, parts = [], []
    for p in LEVELS:
        arr = f"arr{int(p * 10)}"
        ctes.append(
            f"""{arr} AS (SELECT *, least((arrival_seq - 1) // (SELECT count(*) // 3 FROM events), 2) AS part
            FROM ({disorder(p, 0)}))"""
        )
        for name, sql in sides.items():
            rounds = []
            for n in range(3):
                seen = f"(SELECT * FROM {arr} WHERE part <= {n})"
                rounds.append(f"SELECT ids FROM ({sql.replace('FROM events', 'FROM ' + seen).replace('JOIN events', 'JOIN ' + seen)})")
            parts.append(
                f"""SELECT {p}::DOUBLE AS prob, '{name}' AS query_id,
                count(*) FILTER (f.ids IS NOT NULL AND t.ids IS NOT NULL) AS tp,
                count(*) FILTER (t.ids IS NULL) AS fp, count(*) FILTER (f.ids IS NULL) AS fn
                FROM ({" UNION ".join(rounds)}) f FULL JOIN (SELECT DISTINCT ids FROM ({sql})) t ON f.ids = t.ids"""
            )
    return f"""WITH {", ".join(ctes)} SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall
    FROM ({" UNION ALL ".join(parts)})"""


@query("accuracy_under_disorder", accuracy_sql())
def q_accuracy(spark, d):
    specs = {
        "any": pattern(A(), B(), C(), days=1),
        "next": pattern(A(), B(), C(), days=1, policy="next"),
    }
    e = events(spark, d)
    portion = e.agg((F.count(F.lit(1)) / 3).cast("long")).scalar()
    return accuracy_under_disorder(e, specs, LEVELS, rounds=3, rows_per_round=portion, store=scratch(spark))
