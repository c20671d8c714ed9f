"""How right the matches stay when events arrive out of order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import PatternSpec
from .corrections import apply_changelog
from .lifetimes import match_lifetimes, portion_changelog
from .match import match_many
from .perturb import inject_disorder
from .sets import compare_matches


def changelog_accuracy(logs: dict[str, DataFrame], specs: dict[str, PatternSpec], truth: DataFrame) -> DataFrame:
    """Precision and recall of the folded changelogs per query (``query_id``)."""
    found = None
    for name, log in logs.items():
        folded = apply_changelog(None, log, specs[name].keys)
        folded = folded.select(F.lit(name).alias("query_id"), "match_id", "event_ids")
        found = folded if found is None else found.unionByName(folded)
    return compare_matches(found, truth, ["query_id"])


def stored(df: DataFrame, store: str | None, name: str) -> DataFrame:
    """The same rows from a table below ``store``; as they are without one."""
    if store is None:
        return df
    df.write.mode("overwrite").parquet(f"{store}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{store}/{name}")


def accuracy_under_disorder(
    events: DataFrame, specs: dict[str, PatternSpec], probs: Sequence[float], *, rounds: int = 4,
    rows_per_round: int | Column, with_correction: bool = False, seed: int = 0, ts: str = "ts", id: str = "event_id",
    store: str | None = None,
) -> DataFrame:
    """Precision and recall per disorder level and query.

    Events arrive in ``rounds`` portions of ``rows_per_round`` (the last takes the rest).  After every portion the
    changes are published: without correction nothing is ever taken back, with correction matches are also updated and
    deleted, and the changelog of all portions is folded.  What is published follows from the lifetimes of the matches
    (one plan per level and query, no matching per portion).  With a folder ``store`` arrivals and lifetimes are written
    there: they are read several times, and plans stay small.
    """
    truth = match_many(events, specs).select("query_id", "match_id", "event_ids")
    out = None
    for prob in probs:
        arrived = inject_disorder(events, prob, seed=seed, ts=ts, id=id)
        part = F.least(F.floor((F.col("arrival_seq") - 1) / rows_per_round), F.lit(rounds - 1))
        arrived = arrived.withColumn("portion", part.cast("long"))
        arrived = stored(arrived, store, f"{prob}-arrivals")
        lives = {name: stored(match_lifetimes(arrived, spec), store, f"{prob}-{name}") for name, spec in specs.items()}
        if with_correction:
            level = changelog_accuracy({n: portion_changelog(x, specs[n]) for n, x in lives.items()}, specs, truth)
        else:
            found = None
            for name, life in lives.items():
                own = life.select(F.lit(name).alias("query_id"), "match_id", "event_ids")
                found = own if found is None else found.unionByName(own)
            level = compare_matches(found, truth, ["query_id"])
        level = level.select(F.lit(float(prob)).alias("prob"), "*")
        out = level if out is None else out.unionByName(level)
    return out
