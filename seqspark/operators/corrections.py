"""Corrections: the difference between two match tables as a changelog, and its folding."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_ticks, ticks
from ..plans.base import both
from ..spec import PatternSpec

CORE = ["start_ts", "end_ts", "end_id", "n_events", "event_ids", "match_id"]


def slot_keys(m: DataFrame, keys) -> list[str]:
    return [*(["query_id"] if "query_id" in m.columns else []), *keys]


def as_changes(m: DataFrame, keys, kind: str) -> DataFrame:
    return m.select(
        F.lit(kind).alias("kind"), *keys, *CORE, F.lit(None).cast("long").alias("old_match_id")
    )


def diff_matches(
    old: DataFrame, new: DataFrame, keys=(), *, first_plain: bool = True, with_correction: bool = True
) -> DataFrame:
    """Changelog that turns ``old`` into ``new``: insert, update or delete rows.

    An old match that is gone pairs with a new match of the same end that contains it
    (with the same first event when the first step is plain): an update.  The smallest
    such match wins; what stays unpaired is deleted or inserted.  Without correction every
    new match is an insert and nothing is taken back.
    """
    keys = slot_keys(old, keys)
    slot = [*keys, "end_id"]
    sides = [m.select(*keys, *CORE, F.lit(n).alias("_side")) for n, m in enumerate((old, new))]
    both_sides = sides[0].unionByName(sides[1]).repartition(*[F.col(k) for k in slot])
    # One shuffle by slot serves both groupings; only what changed is collected.
    changed = both_sides.groupBy(*slot, *[c for c in CORE if c != "end_id"]).agg(
        F.min("_side").alias("_lo"), F.max("_side").alias("_hi")
    )
    changed = changed.filter("_lo = _hi")
    row = F.struct("n_events", "match_id", "start_ts", "end_ts", "event_ids")
    groups = changed.groupBy(*slot).agg(
        F.array_sort(F.collect_list(F.when(F.col("_lo") == 0, row))).alias("_gone"),
        F.array_sort(F.collect_list(F.when(F.col("_lo") == 1, row))).alias("_come"),
    )

    def change(kind, m, was):
        return F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in CORE if c != "end_id"],
                        was.alias("old_match_id"))

    nothing = F.lit(None).cast("long")
    if not with_correction:
        out = F.transform("_come", lambda m: change("insert", m, nothing))
        return unpack(groups, out, keys)

    def grown(g, m):
        ok = (m["n_events"] > g["n_events"]) & (F.size(F.array_except(g["event_ids"], m["event_ids"])) == 0)
        if first_plain:
            ok = ok & (F.get(m["event_ids"], F.lit(0)) == F.get(g["event_ids"], F.lit(0)))
        return ok

    def target(g):
        return F.get(F.filter("_come", lambda m: grown(g, m)), F.lit(0))["match_id"]

    # Largest old match first, so that it is the one a new match replaces.
    wish = F.transform(F.reverse("_gone"), lambda g: F.struct(g["match_id"].alias("was"), target(g).alias("now")))
    groups = groups.withColumn("_wish", wish)

    def replaced(m):
        return F.get(F.filter("_wish", lambda w: w["now"] == m["match_id"]), F.lit(0))["was"]

    groups = groups.withColumn(
        "_put",
        F.transform("_come", lambda m: change_from(change, m, replaced(m))),
    )
    taken = F.transform("_put", lambda x: x["old_match_id"])
    lost = F.filter("_gone", lambda g: ~F.coalesce(F.array_contains(taken, g["match_id"]), F.lit(False)))
    out = F.concat("_put", F.transform(lost, lambda m: change("delete", m, nothing)))
    return unpack(groups, out, keys)


def change_from(change, m, was):
    return F.when(was.isNull(), change("insert", m, was)).otherwise(change("update", m, was))


def unpack(groups: DataFrame, changes, keys) -> DataFrame:
    rows = groups.select(*keys, "end_id", F.explode(changes).alias("_x"))
    return rows.select("*", "_x.*").drop("_x").select("kind", *keys, *CORE, "old_match_id")


def invalidate(old: DataFrame, new: DataFrame, keys=()) -> DataFrame:
    """Delete rows for old matches that a match with an earlier end makes obsolete:
    the same events up to the shorter one's last."""
    keys = slot_keys(old, keys)
    first = F.get("event_ids", F.lit(0)).alias("_first")
    everything = old.select(*keys, *CORE).unionByName(new.select(*keys, *CORE))
    better = everything.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], first.alias("_f"),
        F.col("event_ids").alias("_ids"), F.col("end_ts").alias("_end"),
    )
    mine = old.select(*keys, *CORE, first)
    n = F.least(F.size("event_ids"), F.size("_ids")) - 1
    same = F.slice("event_ids", 1, n) == F.slice("_ids", 1, n)
    on = both([F.col(k) == F.col(f"_k_{k}") for k in keys]) & (F.col("_first") == F.col("_f"))
    out = mine.join(better, on & same & (F.col("_end") < F.col("end_ts")), "left_semi")
    return as_changes(out, keys, "delete")


def apply_changelog(base: DataFrame | None, log: DataFrame, keys=()) -> DataFrame:
    """Fold a changelog (with ``revision``) into the current matches.

    For every match the newest row decides: an update takes the old match away and puts
    the new one in.
    """
    keys = slot_keys(log, keys)
    ident = [*keys, "end_id", "match_id"]
    puts = log.select(*keys, *CORE, "revision", (F.col("kind") != "delete").alias("_in"))
    takes = log.filter("kind = 'update'").select(
        *keys,
        *[F.lit(None).cast(log.schema[c].dataType).alias(c) if c in ("start_ts", "end_ts", "n_events", "event_ids") else F.col(c)
          for c in ("start_ts", "end_ts", "end_id", "n_events", "event_ids")],
        F.col("old_match_id").alias("match_id"), "revision", F.lit(False).alias("_in"),
    )
    rows = puts.unionByName(takes)
    if base is not None:
        start = base.select(*keys, *CORE, F.lit(-1).cast("long").alias("revision"), F.lit(True).alias("_in"))
        rows = rows.unionByName(start)
    payload = F.struct("_in", *[c for c in CORE if c not in ident])
    newest = rows.groupBy(*ident).agg(F.max_by(payload, F.struct("revision", "_in")).alias("_m"))
    return newest.filter("_m._in").select(*keys, "end_id", "match_id", "_m.*").drop("_in").select(*keys, *CORE)


def expire_events(df: DataFrame, now, spec: PatternSpec) -> DataFrame:
    """Drop events more than two windows older than ``now`` (a tick Column or value)."""
    return df.filter(ticks(df, spec.ts) >= now - 2 * duration_ticks(df, spec.ts, spec.within))


def expire_matches(m: DataFrame, now, within: timedelta | str | int) -> DataFrame:
    """Drop matches that ended more than one window before ``now``."""
    return m.filter(ticks(m, "end_ts") >= now - duration_ticks(m, "end_ts", within))
