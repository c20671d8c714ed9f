"""Patterns with one-or-more steps, read off the events in each end's window.

Every end event is joined once with the earlier events inside its window, which are
collected into one sorted array per step.  The matches are then enumerated right to left
with array functions.  An array holds at most the events of one window of one key: the
same events the matches themselves list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.base import Prepared, both, either, finish
from ..plans.joins import meet_on
from ..plans.scans import running
from ..spec import Step
from . import intervals
from .combos import early_frame, ends_frame
from .folds import bound_steps, depends, greedy, holds, walk


def cand(step: Step) -> Column:
    return F.col(f"_c_{step.name}")


def end_windows(p: Prepared, early_p: Prepared, ends: DataFrame | None = None) -> DataFrame:
    """One row per end event with ``_c_<step>``: the step's candidates in time order.

    The candidates come from ``early_p``, whose events may carry more fields.
    """
    *early, last = p.spec.positive
    meet = meet_on(p.spec.keys, p.spec.salt)
    marks = [p.flag(s).alias(f"_is_{s.name}") for s in early]
    rows = early_p.df.filter(either([p.flag(s) for s in early])).select(*p.spec.keys, "_e", *marks)
    mine, end = F.col("_e")["t"], F.col(last.name)["t"]
    pairs = ends_frame(p, ends).join(early_frame(p, rows, ends), meet)
    pairs = pairs.filter((mine < end) & (end - mine <= p.within))
    lists = [
        F.array_sort(F.collect_list(F.when(F.col(f"_is_{s.name}"), F.col("_e")))).alias(f"_c_{s.name}")
        for s in early
    ]
    return pairs.groupBy(*meet, last.name).agg(*lists).filter(both([F.size(cand(s)) > 0 for s in early]))


def with_previous(p: Prepared) -> Prepared:
    """Give the events of one-or-more steps the time of the latest previous-step event."""
    steps = p.spec.positive
    pairs = [(b, s) for b, s in zip(steps, steps[1:]) if s.kleene]
    if not pairs:
        return p
    when = F.col("_e")["t"]
    measures = {f"_pre_{s.name}": ("max", F.when(p.flag(b), when), True) for b, s in pairs}
    timed = p.df.withColumn("_t", when)
    scanned = running(timed, p.spec.keys, "_t", p.chunk, measures, levels=p.levels)
    event = F.col("_e")
    for name in measures:
        event = event.withField(name, F.col(name))
    return p.having(scanned.withColumn("_e", event).drop("_t", *measures))


def maximal_sets(p: Prepared, step: Step, mine: Column, end: Column) -> Column:
    """The step's largest sets: all its events from a split on.

    A split is an event with a previous-step event between it and the event before it.
    """
    before = f"_pre_{step.name}"

    def splits(e, i):
        seen = e[before] >= end - p.within
        return seen & ((i == 0) | (e[before] >= F.get(mine, i - 1)["t"]))

    starts = F.filter(
        F.transform(mine, lambda e, i: F.when(splits(e, i), i)), lambda i: i.isNotNull()
    )
    return F.transform(
        starts,
        lambda i, n: F.struct(
            F.slice(mine, i + 1, F.size(mine)).alias("set"),
            F.when(i > 0, F.get(mine, i - 1)["t"]).alias("after"),
            (n == 0).alias("first"),
        ),
    )


def all_subsets(p: Prepared, step: Step, mine: Column) -> Column:
    """Every non-empty subset of the candidates that the step's own conditions accept event by event.

    Subsets grow in time order and a rejected one is never continued, so the work follows the valid subsets, not all
    of them. ``max_subset_candidates`` is a guard for those who want one; there is none by default.
    """
    limit = p.spec.max_subset_candidates
    if limit is not None:
        n = F.size(mine)
        text = F.concat(
            F.lit(f"step {step.name}: "), n.cast("string"),
            F.lit(f" candidates in one window, all subsets are listed up to {limit}"),
        )
        mine = F.when(n > limit, F.raise_error(text).cast(f"array<{p.df.schema['_e'].dataType.simpleString()}>")).otherwise(mine)
    start, accept, add = walk(p, step, cross=False)

    def grow(found, e):
        return F.concat(found, F.transform(F.filter(found, lambda s: accept(s, e)), lambda s: add(s, e)))

    found = F.aggregate(mine, F.array(start), grow)
    return F.filter(F.transform(found, lambda s: s["taken"]), lambda s: F.size(s) > 0)


def match_windows(p: Prepared, mode: str, ends: DataFrame | None = None, first_end: bool = False) -> DataFrame:
    """Matches per end; ``first_end`` (interval shapes only) leaves out those that an earlier end has already."""
    steps = p.spec.positive
    last = steps[-1]
    if intervals.applies(p, mode):
        counted = intervals.with_counts(p)
        return intervals.interval_matches(counted, end_windows(counted, counted, ends), mode, first_end)
    if mode != "all":
        for before, step in zip(steps, steps[1:]):
            if depends(step) and step.kleene and before.kleene:
                raise ValueError(
                    f"step {step.name}: conditions on earlier events are not defined for "
                    "maximal matches when the previous step is one-or-more"
                )
    end = F.col(last.name)["t"]
    q = p if mode == "all" else with_previous(p)
    w = end_windows(p, q, ends).withColumn("_head", end).withColumn("_after", F.lit(None).cast("long"))
    for i in range(len(steps) - 2, -1, -1):
        step, right = steps[i], steps[i + 1]
        mine = F.filter(cand(step), lambda e: e["t"] < F.col("_head"))
        if not step.kleene:
            if mode != "all" and right.kleene:
                mine = F.filter(mine, lambda e: F.col("_after").isNull() | (e["t"] >= F.col("_after")))
                if mode == "maximal_compact" and i == 0:
                    mine = F.when(F.col("_first"), mine).otherwise(F.slice(mine, -1, 1))
            w = w.withColumn(step.name, F.explode(mine))
            w = w.withColumn("_head", F.col(step.name)["t"]).withColumn("_after", F.lit(None).cast("long"))
        elif mode == "all":
            w = w.withColumn("_mine", mine).withColumn(step.name, F.explode(all_subsets(p, step, F.col("_mine"))))
            w = w.withColumn("_head", F.get(F.col(step.name), F.lit(0))["t"])
        elif i == 0:
            w = w.withColumn(step.name, mine).filter(F.size(step.name) > 0)
        else:
            w = w.withColumn("_mine", mine)
            w = w.withColumn("_pick", F.explode(maximal_sets(p, step, F.col("_mine"), end)))
            w = w.withColumn(step.name, F.col("_pick")["set"]).withColumn("_after", F.col("_pick")["after"])
            w = w.withColumn("_first", F.col("_pick")["first"])
            w = w.withColumn("_head", F.get(F.col(step.name), F.lit(0))["t"])
    return finish(checked(w, q, mode), q)


def checked(w: DataFrame, p: Prepared, mode: str) -> DataFrame:
    """Apply the conditions that need earlier steps, left to right."""
    for step in p.spec.positive:
        if not depends(step):
            continue
        if not step.kleene:
            w = w.filter(step.cross_when(F.col(step.name), bound_steps(p, step)))
        elif mode == "all":
            w = w.filter(holds(p, F.col(step.name), step))
        else:
            w = w.withColumn(step.name, greedy(p, F.col(step.name), step)).filter(F.size(step.name) > 0)
    return w
