"""Policy contiguous: the very next event of the key must extend the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.base import Prepared, both, first_of, last_of
from ..plans.chain import next_chain
from .following import in_window
from .folds import bound_steps, depends, holds


def contiguous_runs(p: Prepared) -> DataFrame:
    """``p`` must hold every event of the keys, also those no step can use.

    A plain step hops to the next event, a one-or-more step to the next event it cannot
    take; the event reached must fit the next step.
    """
    steps = p.spec.positive
    keys = p.spec.keys
    event = F.col("_e")
    for s in steps:
        event = event.withField(f"_ok_{s.name}", p.flag(s))
    rows = p.df.withColumn("_e", event)
    hops = [~p.flag(s) if s.kleene else F.lit(True) for s in steps[:-1]]
    runs = next_chain(rows, keys, p.chunk, hops, ties=True, levels=p.levels).filter(p.flag(steps[0]))

    link = F.col("hop0")
    runs = runs.withColumn(f"_at_{steps[0].name}", F.col("_e"))
    for i, s in enumerate(steps[1:]):
        runs = runs.withColumn(f"_at_{s.name}", link)
        link = link["nxt"]
    at = {s.name: F.col(f"_at_{s.name}") for s in steps}
    last = steps[-1]
    fits = [F.coalesce(at[s.name][f"_ok_{s.name}"], F.lit(False)) for s in steps]
    runs = runs.filter(both(fits) & in_window(p, at[steps[0].name]["t"], at[last.name]["t"]))
    middle = {s.name: at[s.name].dropFields("nxt") for s in steps[1:-1]}
    runs = runs.select(*keys, *[middle.get(s.name, at[s.name]).alias(s.name) for s in steps])
    for i, s in enumerate(steps[:-1]):
        if s.kleene:
            runs = with_run(p, rows, runs, s, steps[i + 1])
    hidden = [f"_ok_{s.name}" for s in steps]
    for s in steps:
        plain = F.transform(s.name, lambda e: e.dropFields(*hidden)) if s.kleene else F.col(s.name).dropFields(*hidden)
        runs = runs.withColumn(s.name, plain)
    rising = [last_of(a)["t"] < first_of(b)["t"] for a, b in zip(steps, steps[1:])]
    runs = runs.filter(both(rising))
    for s in steps:
        if depends(s) and s.kleene:
            runs = runs.filter(holds(p, F.col(s.name), s))
        elif s.cross_when:
            runs = runs.filter(s.cross_when(F.col(s.name), bound_steps(p, s)))
    return runs


def with_run(p, rows, runs, step, after):
    """Replace the first event of a one-or-more step by all its events up to the next step."""
    keys = p.spec.keys
    ends = next_chain(rows, keys, p.chunk, [~p.flag(step)], ties=True, levels=p.levels)
    ends = ends.filter(p.flag(step) & in_window(p, F.col("_e")["t"], F.col("hop0")["t"]))
    lists = ends.groupBy(*keys, F.col("hop0")["id"].alias("_stop")).agg(
        F.array_sort(F.collect_list("_e")).alias("_run")
    )
    joined = runs.withColumn("_stop", F.col(after.name)["id"]).join(lists, [*keys, "_stop"])
    mine = F.col(step.name)
    return joined.withColumn(
        step.name,
        F.filter("_run", lambda e: (e["t"] > mine["t"]) | ((e["t"] == mine["t"]) & (e["id"] >= mine["id"]))),
    ).drop("_run", "_stop")
