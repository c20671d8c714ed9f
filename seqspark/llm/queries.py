"""Queries of the corpus operators: whole tables, production parameters, the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boilerplate import dedup_lines
from .common import table, words
from .licenses import scan_licenses
from .mixing import mix_sources
from .negatives import mine_negatives
from .oracles import ORACLES
from .packing import pack_documents, piece_digest, sequences
from .pages import main_text
from .passages import fit_quality, held_out, score_quality
from .quality import quality_rules
from .secret_scan import BASE, scan_secrets
from .sharding import uniform_shards
from .similarity import jaccard_groups
from .turns import repair_report
from .vectors import dedup_vectors

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), reread=True)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words"
    )


@query
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = uniform_shards(digest, 24)
    return dealt.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer())
    return piece_digest(sequences(packed, with_parts=True))


@query
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).alias("n"))
    mixed = mix_sources(docs, size=F.col("n"), reread=True)
    facts = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return mixed.groupBy("__row").agg(*facts, F.sum("words").alias("taken")).drop("__row")


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(only_base: bool):
        spans = F.filter("spans", lambda s: s["kind"].isin(*BASE)) if only_base else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"), reread=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
