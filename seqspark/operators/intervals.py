"""Maximal matches as intervals over the sorted events of a window.

In a maximal match a one-or-more step takes a stretch of its events, so a match is an end and two places: how many of
the window's starts lie before its first b, and from which b on it takes all.  Both come from running counts that the
events carry, so matches are found and filtered on whole numbers.  The events of a window are collected once per end;
lists of events are cut from them only in the columns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.base import Prepared
from ..plans.scans import running
from .folds import depends

COUNTS = ("_na", "_nb", "_nbs", "_pa", "_pb", "_pc")


def applies(p: Prepared, mode: str) -> bool:
    """Whether matches of this pattern are intervals: three plain-conditioned steps with a one-or-more step before the end."""
    s = p.spec
    plain = p.rejected is None and not any(depends(x) for x in s.positive)
    return plain and ((s.shape == ".+." and mode in ("maximal", "maximal_compact")) or (s.shape == "++." and mode == "maximal"))


def with_counts(p: Prepared) -> Prepared:
    """Events with ``_na``, ``_nbs`` (starts, b before), ``_nb`` (b up to) and the times of the start, b and end before."""
    a, b, c = p.spec.positive
    t = F.col("_e")["t"]
    measures = {
        "_na": ("sum", F.when(p.flag(a), F.lit(1)), True), "_nb": ("sum", F.when(p.flag(b), F.lit(1)), False),
        "_nbs": ("sum", F.when(p.flag(b), F.lit(1)), True), "_pa": ("max", F.when(p.flag(a), t), True),
        "_pb": ("max", F.when(p.flag(b), t), True), "_pc": ("max", F.when(p.flag(c), t), True),
    }
    scanned = running(p.df.withColumn("_t", t), p.spec.keys, "_t", p.chunk, measures, levels=p.levels)
    event = F.col("_e")
    for name in COUNTS:
        event = event.withField(name, F.coalesce(F.col(name), F.lit(0)) if name.startswith("_n") else F.col(name))
    return p.having(scanned.withColumn("_e", event).drop("_t", *COUNTS))


def hidden(event: Column) -> Column:
    return event.dropFields(*COUNTS)


def interval_matches(p: Prepared, windows: DataFrame, mode: str, first_end: bool) -> DataFrame:
    """Match table from one row per end with ``_c_<step>``, the window's events with their counts."""
    a, b, c = p.spec.positive
    end = F.col(c.name)
    w = windows.select(
        *p.spec.keys, end.alias("_end"), F.col(f"_c_{a.name}").alias("_as"), F.col(f"_c_{b.name}").alias("_bs"),
    )
    # Expressions inside the lambdas look at single events only: an array made for a lambda may be made again per element.
    a0, b0 = F.get("_as", F.lit(0)), F.get("_bs", F.lit(0))
    if a.kleene:

        def place(e, j):
            opens = F.when(j == 0, e["_na"] > a0["_na"]).otherwise(e["_pa"] >= e["_pb"])
            # of b at one time only the first can open a set
            first_of_time = j == e["_nbs"] - b0["_nbs"]
            return F.struct((e["_na"] - a0["_na"]).cast("int").alias("n"), j.alias("skip"), (first_of_time & opens).alias("ok"), e["t"].alias("t"))

        places = F.filter(F.transform("_bs", place), lambda x: x["ok"])
        if first_end:
            before = F.col("_end")["_pc"]
            same_first = before.isNotNull() & ~F.coalesce(a0["_pa"] >= before - p.within, F.lit(False))
            places = F.filter(places, lambda x: ~(same_first & (x["t"] < before)))
    else:

        def place(e, i):
            following = F.get("_as", i + 1)
            latest = following.isNull() | (following["_nb"] > e["_nb"])
            return F.struct(i.alias("n"), (e["_nb"] - b0["_nbs"]).cast("int").alias("skip"), latest.alias("latest"))

        places = F.filter(F.transform("_as", place), lambda x: x["skip"] < F.size("_bs"))
        if mode == "maximal_compact":
            # the starts before the first usable b, and each start that is the latest before its next b
            usable = F.get("_bs", (a0["_nb"] - b0["_nbs"]).cast("int"))
            places = F.filter(places, lambda x: (x["n"] < usable["_na"] - a0["_na"]) | x["latest"])
    w = w.withColumns({
        "_places": places, "_ai": F.transform("_as", lambda e: e["id"]), "_bi": F.transform("_bs", lambda e: e["id"]),
        "_av": F.transform("_as", hidden), "_bv": F.transform("_bs", hidden), "_n": F.size("_bs"),
    })
    w = w.select(*p.spec.keys, "_end", "_ai", "_bi", "_av", "_bv", "_n", F.inline("_places"))
    taken = F.slice("_av", F.lit(1), F.col("n")) if a.kleene else F.get("_av", F.col("n"))
    taken_ids = F.slice("_ai", F.lit(1), F.col("n")) if a.kleene else F.slice("_ai", F.col("n") + 1, F.lit(1))
    rest = F.col("_n") - F.col("skip")
    many = F.col("n") if a.kleene else F.lit(1)
    start = F.get("_av", F.lit(0) if a.kleene else F.col("n"))["t"]
    event_ids = F.concat(taken_ids, F.slice("_bi", F.col("skip") + 1, rest), F.array(F.col("_end")["id"]))
    out = w.select(
        *p.spec.keys, p.time(start).alias("start_ts"), p.time(F.col("_end")["t"]).alias("end_ts"), F.col("_end")["id"].alias("end_id"),
        (many + rest + 1).alias("n_events"), event_ids.alias("event_ids"), taken.alias(a.name), F.slice("_bv", F.col("skip") + 1, rest).alias(b.name),
        hidden(F.col("_end")).alias(c.name),
    )
    core = ["start_ts", "end_ts", "end_id", "n_events", "event_ids"]
    return out.select(*p.spec.keys, *core, F.xxhash64("event_ids").alias("match_id"), a.name, b.name, c.name)
