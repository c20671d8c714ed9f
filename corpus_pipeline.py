"""A training-data pipeline of corpus operators: five stages from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.boilerplate import dedup_lines
from seqspark.llm.common import keep
from seqspark.llm.mixing import mix_sources
from seqspark.llm.packing import pack_documents, piece_digest, sequences
from seqspark.llm.quality import quality_rules
from seqspark.llm.queries import tokenizer
from seqspark.llm.similarity import first_of_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Null, empty and short texts (under 50 words) go; a row is judged by its text alone, so repeated rows all stay or all
    go and ids and sources may be null; an empty table gives no rows.
    """
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that stand on many sites.

    Rows with null or empty texts, repeated rows and null ids all stay; a null text stays null; a null source is no site;
    an empty table gives no rows.
    """
    return dedup_lines(docs.select(*COLUMNS), reread=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, the first of them where ids repeat."""
    return first_of_groups(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per document copy, the copy at a source's border cut to the words it gives.

    Documents without words (null texts among them) give nothing; null sources are one source, the last; rows that
    repeat an id are documents of their own; texts of any length are taken whole; an empty table gives no rows.
    """
    mixed = mix_sources(docs.select(*COLUMNS), reread=True).where("words > 0")
    # a copy that gives all its words stays as it is
    parts = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    first_words = F.array_join(F.slice(parts, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), first_words).otherwise(F.col("text"))
    return mixed.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences; a row per piece, read from the sequences.

    Null texts give the end id alone; equal rows and copies of a document are packed each, told apart by ``doc_row``;
    long texts are cut into pieces; an empty table gives no rows.
    """
    packed = pack_documents(docs.select(*COLUMNS), tokenizer())
    return piece_digest(sequences(packed, with_parts=True))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: The mix is drawn and pieces are packed by methods that SQL does not have; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
