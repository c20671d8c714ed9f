"""When matches come and go while events arrive in portions, and the changelog that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_of, duration_ticks, ticks
from ..plans.base import prepare, relevant_events
from ..plans.sliding import window_extrema
from ..spec import PatternSpec
from .corrections import CORE, diff_matches
from .match import match, match_at_end


def with_payload(spec: PatternSpec, *columns: str) -> PatternSpec:
    return spec.but(payload=list(dict.fromkeys([*spec.payload, *columns])))


def over_events(spec: PatternSpec, value) -> Column:
    """The largest ``value(event)`` over all events of a match, from its step columns."""
    each = []
    for s in spec.positive:
        col = F.col(s.name)
        each.append(F.array_max(F.transform(col, value)) if s.kleene else value(col))
    return F.greatest(*each)


def match_provenance(events: DataFrame, spec: PatternSpec, *, order: str = "arrival_seq", late: str = "is_late") -> DataFrame:
    """All matches with ``arrived``, the arrival of their last-arriving event, and ``is_ooo``: that event was late.

    Such a match could not be found when its end came in order.  Both are folded over the events while they are
    matched (they ride along as payload), so no event is looked up again.
    """
    carried = with_payload(spec, order, late)
    m = match(events, carried)
    last = over_events(carried, lambda e: F.struct(e[order].alias("arrived"), F.coalesce(e[late], F.lit(False)).alias("is_ooo")))
    keep = [c for c in m.columns if c not in ("arrived", "is_ooo")]
    return m.withColumn("_last", last).select(*keep, F.col("_last.arrived").alias("arrived"), F.col("_last.is_ooo").alias("is_ooo"))


def match_lifetimes(arrived: DataFrame, spec: PatternSpec, portion: str = "portion") -> DataFrame:
    """Every match that stands after some portion of the arrivals: the match columns, ``born`` and ``last``.

    Events arrive in portions 0, 1, 2, ...; a match stands from portion ``born`` to ``last`` (null: it is never taken
    back).  The state after any portion n is ``born <= n and (last is null or last >= n)``.

    The matches over all events stand from the portion of their last-arriving event on.  Others can only end in events
    whose window still missed something when they came: a sliding maximum of the portions in every end's own window
    gives the portions after which its matches may have differed, and only these (end, portion) are matched, all in one
    plan with the portion as a further key.  Without disorder nothing is matched twice.
    """
    carried = with_payload(spec, portion)
    final = match(arrived, carried).withColumn("born", over_events(carried, lambda e: e[portion].cast("long")))
    final = final.select(*spec.keys, *CORE, "born", F.lit(None).cast("long").alias("last"))

    p = prepare(arrived, carried, keep_all=spec.policy == "contiguous")
    t, came = F.col("_e")["t"], F.col("_e")[portion].cast("long")
    rows = p.df.select(*spec.keys, t.alias("_t"), came.alias("_came"))
    ends = p.rows(spec.positive[-1]).select(*spec.keys, t.alias("_t"), came.alias("_came"), F.col("_e")["id"].alias("end_id"))
    newest = window_extrema(rows, ends, spec.keys, p.within, p.chunk, {"_newest": ("max", F.col("_came"))})
    torn = ends.join(newest, [*spec.keys, "end_id"]).where("_newest > _came")
    torn = torn.select(*spec.keys, "end_id", "_t", F.explode(F.sequence(F.col("_came"), F.col("_newest") - 1)).alias("_level"))

    # the events of those windows, once per portion after which they are looked at
    width = max(1, duration_ticks(arrived, spec.ts, spec.within))
    k = bucket_of(F.col("_t"), width)
    wanted = torn.select(*spec.keys, "_level", F.explode(F.array(k, k - 1, k - 2)).alias("_k")).distinct()
    used = arrived if spec.policy == "contiguous" else relevant_events(arrived, spec)
    used = used.withColumn("_k", bucket_of(ticks(arrived, spec.ts), width))
    seen = used.join(wanted, [*spec.keys, "_k"]).where(F.col(portion) <= F.col("_level")).drop("_k")
    levelled = spec.but(partition_by=[*spec.partition_by, "_level"])
    found = match_at_end(seen, levelled, torn.select("end_id").distinct(), near=True).select(*levelled.keys, *CORE)
    found = found.join(torn.select(*levelled.keys, "end_id"), [*levelled.keys, "end_id"], "left_semi")
    passing = found.join(final.select(*spec.keys, "end_id", "match_id", "event_ids"), [*spec.keys, "end_id", "match_id", "event_ids"], "left_anti")
    passing = passing.groupBy(*spec.keys, *CORE).agg(F.min("_level").cast("long").alias("born"), F.max("_level").cast("long").alias("last"))
    return final.unionByName(passing)


def portion_changelog(lifetimes: DataFrame, spec: PatternSpec, with_correction: bool = True) -> DataFrame:
    """The changelog (``kind``, match columns, ``old_match_id``, ``revision``) that publishes these lifetimes.

    Revision n turns the matches after portion n - 1 into those after portion n; what goes and what comes at one end in
    one revision is paired as in :func:`diff_matches`.  Without correction every match is inserted and stays.
    """
    gone = lifetimes.where("last is not null").withColumn("revision", F.col("last") + 1)
    come = lifetimes.withColumn("revision", F.col("born"))
    keys = [*spec.keys, "revision"]
    return diff_matches(gone, come, keys, first_plain=not spec.positive[0].kleene, with_correction=with_correction)


def match_status(log: DataFrame, keys=(), provenance: DataFrame | None = None) -> DataFrame:
    """Per match of a changelog how it was published: ``status``, ``emitted_at``, ``gone_at`` (null: it stands).

    ``emitted`` came as an insert, ``updated`` as the correction of an older match, and ``late`` as an insert that a
    late event completed (``is_ooo`` of ``provenance``, from :func:`match_provenance`; without it none is late).
    """
    ident = [*keys, "end_id", "match_id"]
    puts = log.where("kind <> 'delete'").groupBy(*ident).agg(
        F.min_by("kind", "revision").alias("_kind"), F.min("revision").alias("emitted_at"), F.max("revision").alias("_put"),
        F.max("n_events").alias("n_events"), F.first("event_ids").alias("event_ids"),
    )
    replaced = log.where("kind = 'update'").select(*keys, "end_id", F.col("old_match_id").alias("match_id"), "revision")
    takes = log.where("kind = 'delete'").select(*ident, "revision").unionByName(replaced)
    takes = takes.groupBy(*ident).agg(F.max("revision").alias("_take"))
    out = puts.join(takes, ident, "left")
    late = F.lit(False)
    if provenance is not None:
        out = out.join(provenance.select(*ident, "is_ooo").distinct(), ident, "left")
        late = F.coalesce("is_ooo", F.lit(False))
    status = F.when(F.col("_kind") == "update", "updated").when(late, "late").otherwise("emitted")
    # a match that goes and comes back in one revision stands
    gone = F.when(F.col("_take") > F.col("_put"), F.col("_take"))
    return out.select(*ident, "n_events", "event_ids", status.alias("status"), "emitted_at", gone.alias("gone_at"))
