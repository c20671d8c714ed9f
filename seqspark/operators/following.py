"""Policy next: every run takes the next event that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from ..plans.base import Prepared, finish, first_of
from ..plans.chain import next_chain
from ..spec import Step
from .folds import bound_steps, depends, greedy
from .intervals import applies
from .windows import match_windows


def unfold(df: DataFrame, first: Step, rest: list[Step], head: Column, chain: str) -> DataFrame:
    """Spread a nested chain into one column per step."""
    df = df.withColumn(first.name, head)
    link = F.col(chain)
    for i, s in enumerate(rest):
        event = link.dropFields("nxt") if i < len(rest) - 1 else link
        df = df.withColumn(s.name, event)
        link = link["nxt"]
    return df


def in_window(p: Prepared, start: Column, end: Column) -> Column:
    return end - start <= p.within


def next_runs(p: Prepared) -> DataFrame:
    """No one-or-more step: one chain of lookups per start."""
    steps = p.spec.positive
    if any(depends(s) for s in steps):
        return conditional_runs(p)
    chained = next_chain(p.df, p.spec.keys, p.chunk, [p.flag(s) for s in steps[1:]], levels=p.levels)
    runs = unfold(chained.filter(p.flag(steps[0])), steps[0], steps[1:], F.col("_e"), "hop0")
    last = F.col(steps[-1].name)
    return runs.filter(last.isNotNull() & in_window(p, F.col(steps[0].name)["t"], last["t"]))


def from_start(p: Prepared, runs: DataFrame, rows: DataFrame, start: Column) -> DataFrame:
    """Join runs with the rows up to one window after their start.

    The start keeps its bucket and the later rows are copied to the bucket before theirs.
    """
    width = max(1, p.within)
    own = bucket_of(F.col("_e")["t"], width)
    later = rows.withColumn("_k", F.explode(F.array(own, own - 1)))
    pairs = runs.withColumn("_k", bucket_of(start, width)).join(later, [*p.spec.keys, "_k"])
    t = F.col("_e")["t"]
    return pairs.filter((t >= start) & in_window(p, start, t))


def conditional_runs(p: Prepared) -> DataFrame:
    """Steps whose condition looks at earlier events: the earliest candidate per run."""
    steps = p.spec.positive
    first = steps[0]
    start = F.col(first.name)["t"]
    runs = p.rows(first).select(*p.spec.keys, F.col("_e").alias(first.name))
    for before, step in zip(steps, steps[1:]):
        rows = p.rows(step).select(*p.spec.keys, "_e")
        pairs = from_start(p, runs, rows, start).filter(F.col("_e")["t"] > F.col(before.name)["t"])
        if step.cross_when:
            pairs = pairs.filter(step.cross_when(F.col("_e"), bound_steps(p, step)))
        runs = pairs.groupBy(*p.spec.keys, "_k", *[s.name for s in steps if s.name in runs.columns])
        runs = runs.agg(F.min("_e").alias(step.name)).drop("_k")
    return runs


def next_prefixes(p: Prepared) -> DataFrame:
    """One one-or-more step: each run also ends after every prefix of what the step took.

    The step's events each know the rest of the pattern that follows them, so a run is a
    start, a prefix of the step's events, and the chain of the prefix's last event.
    """
    steps = p.spec.positive
    spots = [i for i, s in enumerate(steps) if s.kleene]
    if len(spots) > 1:
        raise ValueError("prefix matches are defined for patterns with a single one-or-more step")
    at = spots[0]
    lead, many, tail = steps[:at], steps[at], steps[at + 1 :]
    if any(depends(s) for s in [*lead, *tail]):
        raise ValueError("prefix matches take conditions on earlier events in the one-or-more step only")
    keys = p.spec.keys
    tails = next_chain(p.df, keys, p.chunk, [p.flag(s) for s in tail], levels=p.levels).filter(p.flag(many))
    rows = tails.filter(F.col("hop0").isNotNull()).select(*keys, "_e", "hop0")
    event = F.col("_e")
    if not lead:
        # The start is itself the first event the step takes.
        runs = p.rows(many).select(*keys, event.alias("_from"))
        start, fits = F.col("_from")["t"], event >= F.col("_from")
    else:
        if len(lead) == 1:
            runs = p.rows(lead[0]).withColumn(lead[0].name, event)
        else:
            runs = next_chain(p.df, keys, p.chunk, [p.flag(s) for s in lead[1:]], levels=p.levels)
            runs = unfold(runs.filter(p.flag(lead[0])), lead[0], lead[1:], event, "hop0")
        runs = runs.select(*keys, *[s.name for s in lead])
        start, fits = F.col(lead[0].name)["t"], event["t"] > F.col(lead[-1].name)["t"]
    pairs = from_start(p, runs, rows, start).filter(fits)
    held = [s.name for s in lead] or ["_from"]
    pairs = pairs.groupBy(*keys, "_k", *held).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("hop0").alias("hop0")))).alias("_all")
    )
    if depends(many):
        taken = F.transform(greedy(p, F.transform("_all", lambda x: x["e"]), many), lambda e: e["id"])
        pairs = pairs.withColumn("_all", F.filter("_all", lambda x: F.array_contains(taken, x["e"]["id"])))
    runs = pairs.select("*", F.posexplode("_all").alias("_i", "_x"))
    runs = runs.withColumn(many.name, F.transform(F.slice("_all", 1, F.col("_i") + 1), lambda x: x["e"]))
    runs = runs.withColumn("hop0", F.col("_x")["hop0"])
    begin = first_of(steps[0])["t"]
    runs = unfold(runs, many, tail, F.col(many.name), "hop0")
    last = F.col(tail[-1].name)
    return runs.filter(last.isNotNull() & in_window(p, begin, last["t"]))


def runs_between(p: Prepared) -> DataFrame:
    """``A B+ C`` keeping the first end only: each start's next-next end with all b between.

    All b between a start and its end have that end as their next end, so they are
    collected once per end and cut per start.
    """
    a, b, c = p.spec.positive
    keys = p.spec.keys
    starts = next_runs(p).select(*keys, a.name, c.name)
    ends = next_chain(p.df, keys, p.chunk, [p.flag(c)], levels=p.levels).filter(p.flag(b) & F.col("hop0").isNotNull())
    ends = ends.filter(in_window(p, F.col("_e")["t"], F.col("hop0")["t"]))
    runs = ends.groupBy(*keys, F.col("hop0").alias(c.name)).agg(
        F.array_sort(F.collect_list("_e")).alias("_bs")
    )
    joined = starts.join(runs, [*keys, c.name])
    return joined.withColumn(b.name, F.filter("_bs", lambda e: e["t"] > F.col(a.name)["t"]))


def next_maximal(p: Prepared, ends: DataFrame | None) -> DataFrame:
    """Maximal matches, keeping the first end among those with the same events before it."""
    steps = p.spec.positive
    plain = not any(depends(s) for s in steps)
    if p.spec.shape == ".+." and plain:
        return finish(runs_between(p), p)
    if p.spec.shape == "++." and applies(p, "maximal"):
        return match_windows(p, "maximal", first_end=True)
    found = match_windows(p, "maximal")
    keys = p.spec.keys
    last = steps[-1].name
    if p.spec.shape == "++.":
        # Same first event and different splits always differ at the split.
        first = F.col(steps[0].name)
        split = W.partitionBy(*keys, F.get(first, F.lit(0))["id"], F.element_at(first, -1)["id"])
        place = F.rank().over(split.orderBy(F.col(last)["t"]))
        return found.withColumn("_place", place).filter("_place = 1").drop("_place")
    order = F.struct(F.col(last)["t"], F.col(last)["id"])
    whole = F.struct(*[c for c in found.columns if c not in keys])
    first_id = F.get("event_ids", F.lit(0)).alias("_first")
    groups = found.groupBy(*keys, first_id).agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("match_id").alias("k"), whole.alias("m")))).alias("_all")
    )
    kind = groups.schema["_all"].dataType.simpleString()

    def clash(kept, new):
        n = F.least(kept["m"]["n_events"], new["m"]["n_events"]) - 1
        same = F.slice(kept["m"]["event_ids"], 1, n) == F.slice(new["m"]["event_ids"], 1, n)
        return same & (kept["o"].getField("t") < new["o"].getField("t"))

    def keep(acc, new):
        return F.when(F.exists(acc, lambda old: clash(old, new)), acc).otherwise(F.concat(acc, F.array(new)))

    kept = F.aggregate("_all", F.array().cast(kind), keep)
    return groups.select(*keys, F.explode(kept).alias("_x")).select(*keys, "_x.m.*")
