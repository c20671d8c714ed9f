"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, replace_columns, running, values, with_row, words
from .draws import even, tree


def share_out(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Divide ``total`` by weight; no share exceeds ``most`` times its size, the excess is shared again by weight."""
    share = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    rest = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in free:
                share[i] = rest * weights[i] / weight
            break
        for i in full:
            share[i] = float(most * sizes[i])
        rest -= sum(most * sizes[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return share


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0,
             seed: int = 11, text: str = "text", source: str = "source", size: Column | None = None) -> tuple[DataFrame, list[dict]]:
    """What the mix takes of every row, and one record per source.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``budget`` times all words. A
    source whose target is k of its sizes and a rest gives every document k times, and then permuted documents until
    the rest is reached; the document at the border gives only its first words, so each source meets its target to
    the word. ``size`` is the number of words where that is known already. The order is a hash of the row's number in the written table, so reruns agree. One row per source comes
    to the driver: the sources are as many as there are weights to state for them.
    """
    if "__row" not in docs.columns:
        docs = docs.withColumn("__row", F.monotonically_increasing_id())
    docs = replace_columns(docs, ["size", "source_size", "target", "taken", "__src", "__mix", "__before"])
    rows = keep(
        docs.withColumns({
            "size": F.coalesce((F.size(words(F.col(text))) if size is None else size).cast("long"), F.lit(0).cast("long")),
            "__src": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null")),
        }).withColumn("__mix", F.xxhash64(F.lit(seed), "__row")),
        "mix-rows",
    )
    totals = rows.groupBy("__src").agg(F.sum("size").alias("size")).collect()
    totals = sorted(((r["__src"], r["size"]) for r in totals), key=lambda x: (x[0] == "null", x[0]))
    sizes = [n for _, n in totals]
    weight = [weights[i % len(weights)] for i in range(len(totals))]
    shares = share_out(sizes, weight, budget * sum(sizes), most)
    sources = []
    for (name, size), target in zip(totals, shares, strict=True):
        passes = min(int(target // size), int(most)) if size else 0
        rest = min(int(round(target - passes * size)), size)
        sources.append({"__src": name, "source_size": size, "target": target, "__passes": passes, "__rest": rest})
    facts = values(docs.sparkSession, sources, "__src string, source_size bigint, target double, __passes bigint, __rest bigint")
    placed = running(rows, "__src", "__mix", "__row", "__before", weight="size").join(F.broadcast(facts), "__src")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    placed = placed.withColumn("taken", F.col("__passes") * F.col("size") + part)
    return placed.drop("__before", "__rest"), sources


def mix_sources(docs: DataFrame, shards: int = 8, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5,
                most: float = 2.0, seed: int = 11, text: str = "text", source: str = "source", size: Column | None = None, reread: bool = False) -> DataFrame:
    """The mix as rows: one per document copy, with ``words`` (taken of it), ``shard`` and ``slot``.

    A splitting tree over the output shards partitions the exact number of copies (blocks) of every source: each node
    draws how its blocks divide between its two halves (multivariate hypergeometric), down to one quota per source
    and shard. The quotas cut every source's permuted blocks into disjoint runs, and each shard is permuted again.
    Numbers are given in two levels, so a source with most rows is spread over many tasks. Documents of which nothing
    is taken give one row with words 0 and no shard. Null texts have size 0 and are not taken; null sources are one
    source, the last; equal rows are separate documents; an empty table gives no rows; input columns with the names
    of results are replaced. ``reread`` says that ``docs`` is a table of Parquet files, whose rows are numbered by their
    place there; otherwise it is written once first.
    """
    results = ["size", "source_size", "target", "copy", "words", "shard", "slot"]
    count = F.size(words(F.col(text))) if size is None else size
    docs = with_row(docs, reread)
    # the draw moves row numbers only; documents join their copies at the end
    narrow = docs.select("__row", F.col(source).alias("__source"), count.alias("__count"))
    plan, sources = mix_plan(narrow, weights, budget, most, seed, source="__source", size=F.col("__count"))
    copies = F.coalesce(F.ceil(F.col("taken") / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).cast("int")
    units = (
        plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), copies - 1))))
        .withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
        .withColumn("__order", F.xxhash64(F.lit(seed + 1), "__row", "copy"))
        .select("__row", "__src", "size", "source_size", "target", "copy", "words", "__order")
    )
    units = keep(units, "mix-units")
    some, none = units.where("words > 0"), units.where("words <= 0")
    counts = {r["__src"]: r["n"] for r in some.groupBy("__src").agg(F.count("*").alias("n")).collect()}
    blocks = [counts.get(s["__src"], 0) for s in sources]
    quotas = tree(random.Random(seed), blocks, even(sum(blocks), shards))
    ends = []
    for s, row in zip(sources, quotas, strict=True):
        total = 0
        ends.append({"__src": s["__src"], "__ends": [total := total + n for n in row]})
    cut = values(docs.sparkSession, ends, "__src string, __ends array<bigint>")
    dealt = (
        running(some, "__src", "__order", "__row", "__unit")
        .join(F.broadcast(cut), "__src")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__unit"))))
        .withColumn("__order", F.xxhash64(F.lit(seed + 2), "__row", "copy"))
        .drop("__ends", "__unit")
    )
    dealt = running(dealt, "shard", "__order", "__row", "slot")
    none = none.withColumn("shard", F.lit(None).cast("int")).withColumn("slot", F.lit(None).cast("long"))
    dealt = dealt.unionByName(none.select(*dealt.columns)).select("__row", *results)
    return replace_columns(docs, results).join(dealt, "__row")
