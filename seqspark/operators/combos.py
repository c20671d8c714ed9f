"""Policy any without one-or-more steps: every combination of events inside the window."""

from __future__ import annotations

from dataclasses import replace as with_fields

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from ..plans.base import Prepared, both, either, finish
from ..plans.joins import early_side, end_side, meet_on

# Ends of one time bucket that are joined in one group when there are no keys.
ENDS_A_GROUP = 256


def cross_ok(p: Prepared, upto=None):
    """All cross-step conditions whose steps are bound as columns (plain steps)."""
    bound = {s.name: F.col(s.name) for s in p.spec.positive}
    return both([s.cross_when(F.col(s.name), bound) for s in p.spec.positive if s.cross_when])


def only_ends(df: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Keep the rows whose event is one of the wanted end events (column ``end_id``)."""
    if ends is None:
        return df
    wanted = ends.select(F.col("end_id").alias("_end")).distinct()
    return df.join(wanted, F.col("_e")["id"] == F.col("_end"), "left_semi")


def ends_frame(p: Prepared, ends: DataFrame | None) -> DataFrame:
    last = p.spec.positive[-1]
    df = only_ends(p.rows(last), ends)
    df = df.select(*p.spec.keys, F.col("_e").alias(last.name))
    own = F.col(last.name)
    return end_side(df, own["t"], max(1, p.within), p.spec.salt, own["id"])


def early_frame(p: Prepared, df: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Earlier events dealt to buckets; with few ends only the buckets those ends need (``near`` events are in them)."""
    df = early_side(df, F.col("_e")["t"], max(1, p.within), p.spec.salt)
    if ends is None or p.near:
        return df
    meet = meet_on(p.spec.keys, p.spec.salt)
    return df.join(ends_frame(p, ends).select(*meet).distinct(), meet, "left_semi")


def counted_rows(p: Prepared, ends: DataFrame | None) -> DataFrame:
    """Ends and earlier events of every bucket, each with running counts of its bucket.

    ``_n``: first-step events before the row; ``_gone``: those of them that are more than a window before it;
    ``_z``: the group of the bucket's ends an end is in, ``_groups`` the number of the last one.
    """
    *early, last = p.spec.positive
    meet, width = meet_on(p.spec.keys, p.spec.salt), max(1, p.within)
    own, first, end = F.col("_own"), F.col(f"_is_{early[0].name}"), F.col(last.name)
    marks = [p.flag(s).alias(f"_is_{s.name}") for s in early]
    rows = p.df.filter(either([p.flag(s) for s in early])).select(*p.spec.keys, "_e", F.col("_e")["t"].alias("_own"), *marks)
    # An event of the bucket's own time is in the window of all its later ends; one of the bucket before leaves it in this bucket.
    before = first & (F.col("_k") > bucket_of(own, width))
    left = F.explode(F.when(before, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = early_frame(p, rows, ends).withColumn("_left", left)
    rows = rows.withColumn("_t", F.when(F.col("_left"), F.try_add(own, F.lit(p.within))).otherwise(own))
    rows = rows.unionByName(ends_frame(p, ends).withColumn("_t", end["t"]), allowMissingColumns=True)
    scan = W.partitionBy(*meet).orderBy("_t").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.count_if(first & ~F.col("_left")).over(scan).cast("int").alias("_n"),
        F.count_if(F.col("_left")).over(scan).cast("int").alias("_gone"),
        F.floor(F.count(end).over(scan) / ENDS_A_GROUP).cast("int").alias("_z"),
    )
    return rows.withColumn("_groups", F.max(F.when(end.isNotNull(), F.col("_z"))).over(W.partitionBy(*meet)))


def by_time(x, y):
    return F.when(x["t"] < y["t"], -1).when(x["t"] > y["t"], 1).otherwise(0)


def match_ranges(p: Prepared, ends: DataFrame | None) -> DataFrame:
    """Combinations where a window holds many: the first step's events come by position from one sorted array.

    Running counts tell which stretch of the array fits the later events, so no event is looked at that is in no match.
    The ends of a bucket are dealt to groups of a fixed size, which all tasks share however few buckets there are.
    """
    p = with_fields(p.timed(), spec=p.spec.but(salt=1))
    first, *between, last = p.spec.positive
    keys = p.spec.keys
    meet = [*meet_on(keys, 1), "_z"]
    rows = counted_rows(p, ends)
    early, to_groups = rows.filter(~F.col("_left")), F.explode(F.sequence(F.lit(0), "_groups")).alias("_z")
    # A number of partitions that is asked for stays: Spark would size the tasks of the joins by their small input.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = "_n" if not between else "_upto"
    out = rows.filter(F.col(last.name).isNotNull()).select(*meet, last.name, "_gone", "_n").repartition(parts, *meet)
    right = last
    for step in reversed(between):
        count = [F.col("_n").alias(upto)] if step is between[0] else []
        cand = early.filter(F.col(f"_is_{step.name}")).select(*meet[:-1], to_groups, F.col("_e").alias(step.name), *count)
        mine = F.col(step.name)["t"]
        inside = (mine < F.col(right.name)["t"]) & (F.col(last.name)["t"] - mine <= p.within)
        # Merge joins hand on one pair at a time; a chain of hash joins holds all matches of an end at once.
        out = out.join(cand.hint("merge"), meet).filter(inside)
        right = step
    listed = F.collect_list(F.when(F.col(f"_is_{first.name}"), F.col("_e")))
    starts = early.groupBy(*meet[:-1]).agg(F.array_sort(listed, by_time).alias("_starts"), F.max("_groups").alias("_groups"))
    starts = starts.select(*meet[:-1], to_groups, "_starts")
    out = out.filter(F.col(upto) > F.col("_gone")).join(starts.hint("merge"), meet)
    # The stretch is not empty here; Spark would list it a second time to test that for a plain explode.
    out = out.withColumn("_i", F.explode_outer(F.sequence("_gone", F.col(upto) - 1)))
    out = out.withColumn(first.name, F.get("_starts", "_i"))
    return finish(out.filter(cross_ok(p)), p)


def match_combinations(p: Prepared, ends: DataFrame | None = None) -> DataFrame:
    """Right to left, so that every join is bounded by the end's window.

    All sides share the hash key (keys, bucket), so each is shuffled once.  Without keys a few MB of events make
    billions of combinations; these are listed from stretches of sorted events.
    """
    if not p.spec.keys:
        return match_ranges(p, ends)
    steps = p.spec.positive
    meet = meet_on(p.spec.keys, p.spec.salt)
    last = steps[-1]
    out, right = ends_frame(p, ends), last
    for step in reversed(steps[:-1]):
        cand = p.rows(step).select(*p.spec.keys, "_e")
        cand = early_frame(p, cand, ends).withColumnRenamed("_e", step.name)
        mine = F.col(step.name)["t"]
        inside = (mine < F.col(right.name)["t"]) & (F.col(last.name)["t"] - mine <= p.within)
        out = out.join(cand, meet).filter(inside)
        right = step
    return finish(out.filter(cross_ok(p)), p)
