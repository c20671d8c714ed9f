"""Counting matches without listing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import bucket_of
from ..plans.base import Prepared, prepare
from ..plans.chain import next_chain
from ..plans.scans import running
from ..spec import PatternSpec, Step
from .combos import early_frame, ends_frame
from .folds import depends
from .following import next_runs
from .match import match
from ..plans.joins import meet_on

BIG = "decimal(38,0)"


def block_scan(rows: DataFrame, by: list[str], measures: dict, reverse: bool, p: Prepared) -> DataFrame:
    """Running sums inside blocks as wide as the window; blocks are cut further where the pattern asks for short chunks."""
    if p.chunk < p.within:
        return running(rows, by, "_t", p.chunk, measures, reverse=reverse)
    scan = W.partitionBy(*by).orderBy(F.col("_t").desc() if reverse else F.col("_t").asc())
    sums = [F.sum(v).over(scan.rangeBetween(W.unboundedPreceding, -1 if strict else 0)).alias(n) for n, (_, v, strict) in measures.items()]
    return rows.select("*", *sums)


def points(p: Prepared, steps: list[Step]) -> DataFrame:
    """One row per key and time with the number of events of every step: ``_t``, ``_k0``, ``_k1``, ..."""
    numbers = [F.count_if(p.flag(s)).alias(f"_k{i}") for i, s in enumerate(steps)]
    return p.df.groupBy(*p.spec.keys, F.col("_e")["t"].alias("_t")).agg(*numbers)


def count_combinations(p: Prepared) -> DataFrame:
    """Policy any without one-or-more steps: products of step-count matrices, linear in the events.

    Time is cut into blocks as wide as the window, so a window is the end of one block and the beginning of the next.
    Entry (i, j) of a stretch's upper-triangular matrix is the number of chains of steps i..j inside it; matrices of
    neighbouring stretches multiply. One scan forwards gives the matrix from the block's start to every end, one
    backwards that from the start of the end's window (a probe row) to the end of the block before. Sums never reach
    further back than a window.
    """
    *early, last = p.spec.positive
    keys, d, width = p.spec.keys, len(early), max(1, p.within)
    kind = "bigint" if d < 3 else BIG  # chains of two steps in one window fit, longer ones may not
    own = points(p, [*early, last]).withColumn("_end", F.when(F.col(f"_k{d}") > 0, F.col("_t")))
    counts = [F.col(f"_k{i}").cast(kind).alias(f"_k{i}") for i in range(d)]
    rows = own.select(*keys, "_t", *counts, F.col(f"_k{d}").alias("_ends"), "_end", F.lit(False).alias("_probe"))
    probes = rows.where("_end is not null").select(
        *keys, (F.col("_t") - width).alias("_t"), *[F.lit(0).cast(kind).alias(f"_k{i}") for i in range(d)], "_ends", "_end", F.lit(True).alias("_probe")
    )
    blocks, by = rows.unionByName(probes).withColumn("_block", bucket_of(F.col("_t"), width)), [*keys, "_block"]

    def known(name, missing):
        return F.lit(1).cast(kind) if missing else F.col(name)

    for length in range(d):
        spans = [(i, i + length) for i in range(d - length)]
        ahead = {f"_f{i}_{j}": ("sum", (F.col(f"_k{j}") * known(f"_f{i}_{j - 1}", i == j)).cast(kind), True) for i, j in spans}
        blocks = block_scan(blocks, by, ahead, False, p).withColumns({n: F.coalesce(n, F.lit(0)).cast(kind) for n in ahead})
    for length in range(d):
        # chains from step 0 are asked for at the probe and include events at its time; the others stand behind an event
        back = {}
        for i in range(d - length):
            j = i + length
            value = (F.col(f"_k{i}") * known(f"_r{i + 1}_{j}", i == j)).cast(kind)
            back[f"_r{i}_{j}"] = ("sum", value, i > 0)
        blocks = block_scan(blocks, by, back, True, p).withColumns({n: F.coalesce(n, F.lit(0)).cast(kind) for n in back})
    forth = F.struct(*[F.col(f"_f{i}_{d - 1}") for i in range(d)])
    behind = F.struct(*[F.col(f"_r0_{j}") for j in range(d)])
    ends = blocks.where("_end is not null").groupBy(*keys, "_end").agg(
        F.max(F.when(~F.col("_probe"), forth)).alias("f"), F.max(F.when(F.col("_probe"), behind)).alias("r"), F.max("_ends").alias("_ends")
    )
    total = F.col("f")[f"_f0_{d - 1}"] + F.col("r")[f"_r0_{d - 1}"]
    for m in range(1, d):
        total = total + F.col("r")[f"_r0_{m - 1}"] * F.col("f")[f"_f{m}_{d - 1}"]
    return ends.select(*keys, (total.cast(BIG) * F.col("_ends")).cast(BIG).alias("_n"))


def count_pairs(p: Prepared, weight) -> DataFrame:
    """``A B+ C``: pairs of start and end, weighted by the number k of b between them.

    k comes from running counts, so the b themselves are not joined.
    """
    a, b, c = p.spec.positive
    keys = p.spec.keys
    t = F.col("_e")["t"]
    one = F.when(p.flag(b), F.lit(1))
    # b strictly before c, and b up to and including the time of a
    measures = {"_before": ("sum", one, True), "_upto": ("sum", one, False)}
    rows = running(p.df.withColumn("_t", t), keys, "_t", p.chunk, measures, levels=p.levels)
    event = F.col("_e")
    for name in measures:
        event = event.withField(name, F.coalesce(F.col(name), F.lit(0)))
    rows = rows.withColumn("_e", event).drop("_t", *measures)
    q = p.having(rows)
    starts = rows.filter(p.flag(a)).select(*keys, "_e")
    pairs = ends_frame(q, None).join(early_frame(q, starts, None), meet_on(keys, p.spec.salt))
    start, end = F.col("_e"), F.col(c.name)
    pairs = pairs.filter((start["t"] < end["t"]) & (end["t"] - start["t"] <= p.within))
    k = end["_before"] - start["_upto"]
    return pairs.filter(k > 0).select(*keys, weight(k).cast(BIG).alias("_n"))


def subsets_of(k: Column) -> Column:
    """Exact 2^k - 1; beyond 38 digits the sum fails instead of rounding."""
    one, low = F.lit(1).cast("long"), F.lit(62)
    small = F.call_function("shiftleft", one, F.least(k, low).cast("int")).cast(BIG)
    rest = F.greatest(k - low, F.lit(0)).cast("int")
    big = F.when(rest < 62, F.call_function("shiftleft", one, rest)).otherwise(
        F.raise_error(F.lit("more than 2^124 subsets for one pair of start and end")).cast("long")
    )
    return (small * big.cast(BIG)).cast(BIG) - 1


def count_maximal(p: Prepared) -> DataFrame:
    """``A B+ C`` maximal: per end, the starts in the window before its latest b."""
    a, b, c = p.spec.positive
    keys = p.spec.keys
    t = F.col("_e")["t"]
    end = F.when(p.flag(c), F.col("_e")["id"]).alias("_end")
    rows = p.df.select(
        *keys, t.alias("_t"), p.flag(a).alias("_a"), p.flag(b).alias("_b"), end, F.lit(False).alias("_probe")
    )
    probes = p.rows(c).select(
        *keys, (t - p.within).alias("_t"), F.lit(False).alias("_a"), F.lit(False).alias("_b"),
        F.col("_e")["id"].alias("_end"), F.lit(True).alias("_probe"),
    )
    one = {"_n": ("sum", F.when(F.col("_a"), F.lit(1)), True)}
    rows = running(rows.unionByName(probes), keys, "_t", p.chunk, one, levels=p.levels)
    rows = rows.withColumn("_n", F.coalesce("_n", F.lit(0)))
    # the starts before the latest b grow with b, so the maximum is the latest b's
    latest = {"_nb": ("max", F.when(F.col("_b"), F.col("_n")), True)}
    rows = running(rows, keys, "_t", p.chunk, latest, levels=p.levels).filter(F.col("_end").isNotNull())
    per_end = rows.groupBy(*keys, "_end").agg(
        F.max(F.when(~F.col("_probe"), F.coalesce("_nb", F.lit(0)))).alias("hi"),
        F.max(F.when(F.col("_probe"), F.col("_n"))).alias("lo"),
    )
    return per_end.select(*keys, F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast(BIG).alias("_n"))


def with_closers(p: Prepared, rows: DataFrame) -> DataFrame:
    """Add ``_a``, ``_h``: starts up to a time, and times of b up to it that some start precedes since the b before.

    ``rows`` has ``_t`` and the counts ``_k0`` (starts) and ``_k1`` (b); probe rows count nothing.
    """
    a, b, t = F.col("_k0"), F.col("_k1"), F.col("_t")
    measures = {"_a": ("sum", a, False), "_pa": ("max", F.when(a > 0, t), True), "_pb": ("max", F.when(b > 0, t), True)}
    rows = running(rows, p.spec.keys, "_t", p.chunk, measures, levels=p.levels)
    closer = (b > 0) & F.col("_pa").isNotNull() & (F.col("_pb").isNull() | (F.col("_pa") >= F.col("_pb")))
    rows = rows.withColumn("_c", F.coalesce(closer, F.lit(False)).cast("long")).drop("_pa", "_pb")
    rows = running(rows, p.spec.keys, "_t", p.chunk, {"_h": ("sum", F.col("_c"), False)}, levels=p.levels)
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_a", "_h")})


def window_points(p: Prepared, hops: list[int]) -> DataFrame:
    """Per end of ``A B+ C``/``A+ B+ C``: counts at the end, at its window's start, and at what follows that start.

    Columns: the keys, ``_end``, ``_ends``, ``at`` (the end's own point), ``lo`` (the probe just before the window)
    and ``hop0`` (the next point with an event of step ``hops[0]`` after it, ``nxt`` the next one of ``hops[1]``).
    """
    a, b, c = p.spec.positive
    keys = p.spec.keys
    own = points(p, [a, b, c]).withColumn("_end", F.when(F.col("_k2") > 0, F.col("_t"))).withColumn("_probe", F.lit(False))
    none = {n: F.lit(0).cast("long") for n in ("_k0", "_k1")}
    probes = own.where("_end is not null").withColumns(none).withColumns({"_t": F.col("_t") - p.within - 1, "_probe": F.lit(True)})
    rows = with_closers(p, own.unionByName(probes))
    event = F.struct(F.col("_t").alias("t"), "_a", "_h", "_k0", "_c")
    rows = rows.select(*keys, event.alias("_e"), "_k0", "_k1", F.col("_k2").alias("_ends"), "_end", "_probe")
    chained = next_chain(rows, keys, p.chunk, [F.col(f"_k{i}") > 0 for i in hops], levels=p.levels).where("_end is not null")
    return chained.groupBy(*keys, "_end").agg(
        F.max("_ends").alias("_ends"), F.max(F.when(~F.col("_probe"), F.col("_e"))).alias("at"), F.max(F.when(F.col("_probe"), F.col("_e"))).alias("lo"),
        F.max(F.when(F.col("_probe"), F.col("hop0"))).alias("hop0"),
    )


def count_compact(p: Prepared) -> DataFrame:
    """``A B+ C`` compact: the starts before the window's first usable b, and one per later b that closes a start."""
    ends = window_points(p, [0, 1])
    b0, at = F.col("hop0")["nxt"], F.col("at")
    before = b0["_a"] - b0["_k0"] - F.col("lo")["_a"]
    later = at["_h"] - at["_c"] - b0["_h"]
    n = F.when(b0["t"] < F.col("_end"), before + later).otherwise(0)
    return ends.select(*p.spec.keys, (F.coalesce(n, F.lit(0)) * F.col("_ends")).cast(BIG).alias("_n"))


def count_two_kleene(p: Prepared) -> DataFrame:
    """``A+ B+ C`` maximal: one match per b that closes a start inside the window."""
    ends = window_points(p, [1])
    b1, at = F.col("hop0"), F.col("at")
    first = (b1["_a"] - b1["_k0"] > F.col("lo")["_a"]).cast("long")
    n = F.when(b1["t"] < F.col("_end"), first + at["_h"] - at["_c"] - b1["_h"]).otherwise(0)
    return ends.select(*p.spec.keys, (F.coalesce(n, F.lit(0)) * F.col("_ends")).cast(BIG).alias("_n"))


def count_next_prefix(p: Prepared) -> DataFrame:
    """``A B+ C`` next prefix: per start the b between it and the latest c of its window."""
    a, b, c = p.spec.positive
    keys = p.spec.keys
    own = points(p, [a, b, c]).withColumn("_start", F.when(F.col("_k0") > 0, F.col("_t"))).withColumn("_probe", F.lit(False))
    none = {n: F.lit(0).cast("long") for n in ("_k1", "_k2")}
    probes = own.where("_start is not null").withColumns(none).withColumns({"_t": F.col("_t") + p.within, "_probe": F.lit(True)})
    rows = own.unionByName(probes)
    rows = running(rows, keys, "_t", p.chunk, {"_b": ("sum", F.col("_k1"), False)}, levels=p.levels).withColumn("_b", F.coalesce("_b", F.lit(0)))
    # the b before the latest c; they grow with c, so the largest is the latest c's
    latest = {"_until": ("max", F.when(F.col("_k2") > 0, F.col("_b") - F.col("_k1")), False)}
    rows = running(rows, keys, "_t", p.chunk, latest, levels=p.levels).where("_start is not null")
    starts = rows.groupBy(*keys, "_start").agg(
        F.max("_k0").alias("_starts"), F.max(F.when(F.col("_probe"), F.col("_until"))).alias("hi"), F.max(F.when(~F.col("_probe"), F.col("_b"))).alias("lo")
    )
    n = F.greatest(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(0))
    return starts.select(*keys, (n * F.col("_starts")).cast(BIG).alias("_n"))


def count_negation(p: Prepared) -> DataFrame:
    """``A !N C`` any: per end the starts of its window after the latest negated event."""
    a, n, c = p.spec.steps
    keys = p.spec.keys
    own = points(p, [a, n, c]).withColumn("_end", F.when(F.col("_k2") > 0, F.col("_t"))).withColumn("_probe", F.lit(False))
    none = {x: F.lit(0).cast("long") for x in ("_k0", "_k1")}
    probes = own.where("_end is not null").withColumns(none).withColumns({"_t": F.col("_t") - p.within - 1, "_probe": F.lit(True)})
    rows = running(own.unionByName(probes), keys, "_t", p.chunk, {"_a": ("sum", F.col("_k0"), False)}, levels=p.levels)
    rows = rows.withColumn("_a", F.coalesce("_a", F.lit(0)))
    cut = {"_cut": ("max", F.when(F.col("_k1") > 0, F.col("_a")), False)}
    rows = running(rows, keys, "_t", p.chunk, cut, levels=p.levels).where("_end is not null")
    ends = rows.groupBy(*keys, "_end").agg(
        F.max("_k2").alias("_ends"), F.max(F.when(~F.col("_probe"), F.col("_a") - F.col("_k0"))).alias("hi"),
        F.max(F.when(~F.col("_probe"), F.col("_cut"))).alias("cut"), F.max(F.when(F.col("_probe"), F.col("_a"))).alias("lo"),
    )
    found = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce("cut", F.lit(0))), F.lit(0))
    return ends.select(*keys, (found * F.col("_ends")).cast(BIG).alias("_n"))


def count_matches(events: DataFrame, spec: PatternSpec, per_key: bool = False) -> DataFrame:
    """Number of matches (``n_matches``), in total or per partition key."""
    keys = list(spec.keys) if per_key else []
    plain = not any(depends(s) for s in spec.steps)
    simple = plain and not any(s.negated for s in spec.steps)
    any_policy = spec.policy == "any" and simple
    if any_policy and not spec.has_kleene:
        found = count_combinations(prepare(events, spec))
    elif any_policy and spec.shape == ".+." and spec.mode == "maximal":
        found = count_maximal(prepare(events, spec))
    elif any_policy and spec.shape == ".+." and spec.mode == "all":
        found = count_pairs(prepare(events, spec), subsets_of)
    elif any_policy and spec.shape == ".+." and spec.mode == "maximal_compact":
        found = count_compact(prepare(events, spec))
    elif any_policy and spec.shape == "++." and spec.mode in ("maximal", "maximal_compact"):
        found = count_two_kleene(prepare(events, spec))
    elif spec.policy == "any" and plain and not simple and spec.shape == "..":
        found = count_negation(prepare(events, spec))
    elif spec.policy == "next" and simple and spec.mode == "prefix" and spec.shape == ".+.":
        found = count_next_prefix(prepare(events, spec))
    elif spec.policy == "next" and simple and spec.mode == "maximal" and spec.shape == ".+.":
        found = next_runs(prepare(events, spec)).withColumn("_n", F.lit(1))
    else:
        found = match(events, spec).withColumn("_n", F.lit(1))
    return found.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_n").cast(BIG)), F.lit(0)).cast(BIG).alias("n_matches"))
