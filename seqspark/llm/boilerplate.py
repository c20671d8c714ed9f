"""Line dedup: lines that spread over many sites are found with HyperLogLog sketches and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, replace_columns, with_row, without_spaces


def _hashes(line: Column) -> list[Column]:
    """128 bits of a line, as two columns."""
    return [F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit("second"), line).alias("__h2")]


def explode_lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """One narrow row per line with a word: row number, place, two hashes, site. Texts stay behind."""
    lines = docs.select("__row", F.col(site).cast("string").alias("__site"), F.posexplode(F.split(text, "\n")).alias("__pos", "__line"))
    return lines.where(F.length(without_spaces(F.col("__line"))) > 0).select("__row", "__pos", "__site", *_hashes(F.col("__line")))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """Lines on ``min_sites`` or more sites: __h1, __h2, __sites, and the place of the first occurrence.

    Every task sketches the sites of its lines and only sketches are merged by aggregation, so a line of any
    frequency costs one sketch per task. A sketch of 2^lg_k counters errs by 1.04 / sqrt(2^lg_k) per sigma; within five
    sigmas (one site at least) of the threshold the line's sites are counted exactly instead. Lines that occur fewer
    than ``min_sites`` times cannot be on that many sites and are left out before.
    """
    often = (
        lines.groupBy("__h1", "__h2")
        .agg(F.count("*").alias("__n"), F.min(F.struct("__row", "__pos")).alias("__first"))
        .where(F.col("__n") >= min_sites)
    )
    often = keep(often, "frequent-lines")
    # one row per line, site and task at most reaches the sketches: the hot line shrinks before its shuffle
    seen = lines.join(often.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").where(F.col("__site").isNotNull())
    seen = keep(seen.groupBy("__h1", "__h2", "__site").agg(F.count("*").alias("__n")), "line-sites")
    sketched = seen.groupBy("__h1", "__h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", lg_k)).alias("__estimate"))
    band = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    near = F.abs(F.col("__estimate") - min_sites) <= band
    exact = (
        seen.join(sketched.where(near), ["__h1", "__h2"], "left_semi")
        .groupBy("__h1", "__h2")
        .agg(F.countDistinct("__site").alias("__sites"))
    )
    clear = sketched.where(~near).select("__h1", "__h2", F.col("__estimate").cast("long").alias("__sites"))
    wide = exact.unionByName(clear).where(F.col("__sites") >= min_sites)
    return wide.join(often.select("__h1", "__h2", "__first"), ["__h1", "__h2"])


def dedup_lines(docs: DataFrame, min_sites: int = 5, keep_first: bool = True, text: str = "text", site: str = "source", key: str = "doc_id", reread: bool = False) -> DataFrame:
    """Remove from every text the lines that stand on ``min_sites`` or more distinct sites.

    Returns all input columns with the cleaned text, and ``n_lines``, ``n_removed`` (columns of these names are
    replaced). With ``keep_first`` the first occurrence in order of (key, place) stays, so no text is lost everywhere.
    Lines are compared whole; lines without a word are never removed. Null texts stay null with 0 lines; null sites
    are no site; rows with one key are told apart by a row number, and equal rows are separate; ties in the key go by
    row number; an empty table gives no rows. Every document stays. ``reread`` says that ``docs`` is a table of Parquet
    files, whose rows are numbered by their place there; otherwise it is written once first.
    """
    docs = replace_columns(docs, ["n_lines", "n_removed", "__row", "__bad", "__order"])
    # the row number starts with the key's order, so min(row, place) is the first occurrence
    rows = with_row(docs, reread, "__order")
    rows = rows.withColumn("__row", F.struct(F.col(key).alias("k"), F.col("__order").alias("r"))).drop("__order")
    lines = keep(explode_lines(rows, text, site), "lines")
    wide = keep(spread_lines(lines, min_sites), "boilerplate")
    bad = lines.join(wide, ["__h1", "__h2"])
    if keep_first:
        bad = bad.where((F.col("__row") != F.col("__first.__row")) | (F.col("__pos") != F.col("__first.__pos")))
    bad = bad.groupBy("__row").agg(F.collect_list("__pos").alias("__bad"))
    counts = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(without_spaces(x)) > 0))
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("__bad", i)), "\n")
    joined = rows.join(bad, (rows["__row"]["k"].eqNullSafe(bad["__row"]["k"])) & (rows["__row"]["r"] == bad["__row"]["r"]), "left")
    return joined.select(
        *[F.when(F.col("__bad").isNull(), rows[c]).otherwise(cleaned).alias(c) if c == text else rows[c] for c in docs.columns],
        F.coalesce(F.when(rows[text].isNotNull(), counts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__bad"), F.lit(0)).cast("long").alias("n_removed"),
    )
