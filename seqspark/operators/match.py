"""The matching entry points."""

from __future__ import annotations

from dataclasses import replace as with_fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.base import Prepared, as_column, finish, prepare
from ..plans.scans import running
from ..spec import PatternSpec
from .adjacent import contiguous_runs
from .combos import match_combinations
from .following import next_maximal, next_prefixes, next_runs
from .near import near_ends
from .windows import match_windows


def count_negated(p: Prepared) -> Prepared:
    """Give every event the number of negated events before and up to its time."""
    negated = next(s for s in p.spec.steps if s.negated)
    one = F.when(p.flag(negated), F.lit(1))
    timed = p.df.withColumn("_t", F.col("_e")["t"])
    measures = {"_neg_before": ("sum", one, True), "_neg_upto": ("sum", one, False)}
    scanned = running(timed, p.spec.keys, "_t", p.chunk, measures, levels=p.levels)
    event = F.col("_e")
    for name in measures:
        event = event.withField(name, F.coalesce(F.col(name), F.lit(0)))
    return p.having(scanned.withColumn("_e", event).drop("_t", *measures))


def run(events: DataFrame, spec: PatternSpec, ends: DataFrame | None, rejected: bool, near: bool = False) -> DataFrame:
    negated = any(s.negated for s in spec.steps)
    if rejected and not negated:
        raise ValueError("the pattern has no negated step")
    if spec.policy == "contiguous" and negated:
        raise ValueError("contiguous matches have nothing between their steps to negate")
    p = with_fields(prepare(events, spec, keep_all=spec.policy == "contiguous"), near=near)
    if negated:
        p = with_fields(count_negated(p), rejected=rejected)
    if spec.policy == "any":
        if spec.has_kleene:
            return match_windows(p, spec.mode, ends)
        return match_combinations(p, ends)
    if spec.policy == "contiguous":
        found = finish(contiguous_runs(p), p)
    elif not spec.has_kleene:
        found = finish(next_runs(p), p)
    elif spec.mode == "prefix":
        found = finish(next_prefixes(p), p)
    else:
        found = next_maximal(p, ends)
    if ends is not None:
        found = found.join(ends.select("end_id").distinct(), "end_id", "left_semi")
    return found


def match(events: DataFrame, spec: PatternSpec) -> DataFrame:
    """All matches of the pattern.

    Columns: the keys, ``start_ts``, ``end_ts``, ``end_id``, ``n_events``, ``event_ids``,
    ``match_id`` and one column per step (a struct, or an array of structs for a
    one-or-more step).
    """
    return run(events, spec, None, False)


def match_at_end(events: DataFrame, spec: PatternSpec, ends: DataFrame, near: bool = False) -> DataFrame:
    """Only the matches that end in the given events (column ``end_id``).

    Policy any reads just the windows of those ends; the other policies first narrow the
    events to the time buckets around them, unless ``near`` says that this is done.
    """
    if spec.policy != "any" and not near:
        events = near_ends(events, ends, spec)
    return run(events, spec, ends, False, near)


def negated_matches(events: DataFrame, spec: PatternSpec) -> DataFrame:
    """The sequences a negated step rejects."""
    return run(events, spec, None, True)


def match_many(events: DataFrame, specs: dict[str, PatternSpec]) -> DataFrame:
    """Several patterns over one event table; ``query_id`` tells the matches apart.

    The patterns may partition by different keys, so only the common columns are kept.
    """
    common = ["start_ts", "end_ts", "end_id", "n_events", "event_ids", "match_id"]
    shared = set.intersection(*[set(s.keys) for s in specs.values()])
    first = next(iter(specs.values()))
    columns = ["query_id", *[k for k in first.keys if k in shared], *common]
    out = None
    for name, spec in specs.items():
        found = match(events, spec).withColumn("query_id", F.lit(name)).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out


def route_to_queries(events: DataFrame, specs: dict[str, PatternSpec]) -> DataFrame:
    """One row per event and query that can use it (``query_id``).

    The conditions are plain columns, so the fan-out is one pass without a join.
    """
    wants = []
    for name, spec in specs.items():
        used = F.lit(False)
        for s in spec.steps:
            used = used | F.coalesce(as_column(s.when), F.lit(False))
        wants.append(F.when(used, F.lit(name)))
    hit = F.filter(F.array(*wants), lambda q: q.isNotNull())
    return events.select("*", F.explode(hit).alias("query_id"))


def participants(m: DataFrame, id: str) -> DataFrame:
    return m.select(F.explode("event_ids").alias(id)).distinct()


def participating_events(events: DataFrame, m: DataFrame, id: str = "event_id") -> DataFrame:
    """Events that take part in at least one match."""
    return events.join(participants(m, id), id, "left_semi")


def idle_events(events: DataFrame, m: DataFrame, id: str = "event_id") -> DataFrame:
    """Events that take part in no match."""
    return events.join(participants(m, id), id, "left_anti")


def format_matches(m: DataFrame, name: str = "{id}") -> DataFrame:
    """A printable ``line`` per match: the event names and ``[start - end]``.

    ``name`` is a template for one event, e.g. ``"e{id}"``.
    """
    head, tail = name.split("{id}")
    names = F.transform("event_ids", lambda e: F.concat(F.lit(head), e.cast("string"), F.lit(tail)))
    span = F.format_string("[%s - %s]", F.col("start_ts").cast("string"), F.col("end_ts").cast("string"))
    return m.withColumn("line", F.concat_ws(" ", F.concat_ws(" ", names), span))
