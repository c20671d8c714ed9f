"""Time the headline queries on whole tables and print one JSON line.

``letters_*`` run on the event table as one unpartitioned stream with one event per time
unit and windows of 10 / 100 / 1000 units, the setting of the published numbers in
events of the three kinds, one per time unit, made from the table: the published size and
density, for the widest windows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from seqspark import PatternSpec, Step, count_matches, match
from seqspark.catalogue import QUERIES

KINDS = {"a": "view", "b": "click", "c": "purchase"}

# name -> (pattern, policy, mode, windows)
LETTERS = {
    "letters_next_abc": ("a b c", "next", "all", (10, 100, 1000)),
    "letters_next_ab+c": ("a b+ c", "next", "maximal", (10, 100, 1000)),
    "letters_next_ab+c_prefix": ("a b+ c", "next", "prefix", (10, 100)),
    "letters_next_a+b+c": ("a+ b+ c", "next", "maximal", (10, 100)),
    "letters_any_abc": ("a b c", "any", "all", (10, 100)),
    "letters_any_ab+c": ("a b+ c", "any", "maximal_compact", (10, 100)),
    "letters_any_a+b+c": ("a+ b+ c", "any", "maximal", (10, 100)),
}
DENSE = {
    "dense_next_abc": ("a b c", "next", "all", (10, 100, 1000)),
    "dense_next_ab+c_prefix": ("a b+ c", "next", "prefix", (1000,)),
    "dense_next_a+b+c": ("a+ b+ c", "next", "maximal", (10, 100, 1000)),
    "dense_any_ab+c": ("a b+ c", "any", "maximal_compact", (1000,)),
    "dense_any_a+b+c": ("a+ b+ c", "any", "maximal", (1000,)),
}
DENSE_ROWS = 10_000
COUNTS = {
    "letters_count_any_abc": ("a b c", "any", "all", (1000,)),
    "letters_count_any_ab+c": ("a b+ c", "any", "maximal", (1000,)),
}
TABLES = [
    "match_any_3d", "match_any_7d", "match_next_3d", "match_next_prefix", "match_any_maximal",
    "match_next_maximal_two_kleene", "match_contiguous", "match_negation", "count_any_7d",
    "next_event", "window_join", "adaptive_threshold", "event_stats", "diff_matches_maximal",
    "normalise_mixed", "inject_disorder",
]


def spec(text: str, policy: str, mode: str, within: int) -> PatternSpec:
    steps = [
        Step(w[0], f"event_type = '{KINDS[w[0]]}'", kleene=w.endswith("+")) for w in text.split()
    ]
    return PatternSpec(steps, within=within, policy=policy, mode=mode, ts="event_id", chunk=max(within, 5000))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "event_type")
    jobs = {}
    for name, (text, policy, mode, windows) in LETTERS.items():
        for w in windows:
            jobs[f"{name}_w{w}"] = lambda s=spec(text, policy, mode, w): match(events, s)
    for name, (text, policy, mode, windows) in COUNTS.items():
        for w in windows:
            jobs[f"{name}_w{w}"] = lambda s=spec(text, policy, mode, w): count_matches(events, s)
    kinds = events.where(F.col("event_type").isin(*KINDS.values()))
    first = kinds.orderBy("event_id").limit(DENSE_ROWS)
    dense = first.select(F.row_number().over(Window.orderBy("event_id")).cast("long").alias("event_id"), "event_type").persist()
    for name, (text, policy, mode, windows) in DENSE.items():
        for w in windows:
            jobs[f"{name}_w{w}"] = lambda s=spec(text, policy, mode, w): match(dense, s)
    for name in TABLES:
        jobs[name] = lambda q=QUERIES[name]: q(spark, folder)
    drain(jobs["match_next_3d"]())
    times = {}
    for name, job in jobs.items():
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        drain(job())
        times[name] = round(time.perf_counter() - start, 3)
        if only:
            print(name, times[name], flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
