"""Row numbers do not depend on how a table's files are split among tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqspark.llm import boilerplate, common, components, mixing, similarity

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def files(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.select("doc_id", "text", "lang", "source", "n_chars").repartition(13).write.parquet(path)
    return path


@pytest.fixture
def shifting(spark, monkeypatch):
    """Every written table changes how files are split: one task for all of them, then one for each."""
    calls = []

    def keep(df, name, real=common.keep):
        out = real(df, name)
        calls.append(name)
        spark.conf.set(SPLITS, 1 if len(calls) % 2 else 50)
        return out

    for module in (boilerplate, common, components, mixing, similarity):
        monkeypatch.setattr(module, "keep", keep, raising=False)
    spark.conf.set(SPLITS, 50)
    yield calls
    spark.conf.unset(SPLITS)


def test_splits_do_differ(spark, files, shifting):
    many = spark.read.parquet(files).select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set(SPLITS, 1)
    assert many > spark.read.parquet(files).select(F.spark_partition_id().alias("p")).distinct().count() == 1


def numbers(spark, df):
    return {r["__row"]: r["text"] for r in df.select("__row", "text").collect()}


def test_numbers_are_places_in_the_files(spark, files, corpus):
    found = []
    for n in (1, 50):
        spark.conf.set(SPLITS, n)
        found.append(numbers(spark, common.with_row(spark.read.parquet(files).withColumn("more", F.length("text")), True)))
    spark.conf.unset(SPLITS)
    assert found[0] == found[1] and len(found[0]) == len(corpus)


def test_beyond_the_bound_and_other_inputs_are_written(spark, files, corpus, monkeypatch):
    monkeypatch.setattr(common, "FILES", 3)
    for df, reread in ((spark.read.parquet(files), True), (spark.read.parquet(files).orderBy(F.rand()), False)):
        df = common.with_row(df, reread)
        assert numbers(spark, df) == numbers(spark, df) and len(numbers(spark, df)) == len(corpus)


def test_no_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "none"))
    assert common.with_row(spark.read.parquet(str(tmp_path / "none")), True).collect() == []


def test_operators_agree_under_other_splits(spark, files, corpus, shifting):
    from test_rules_and_lines import brute_lines
    from test_similarity import brute

    rows = [(r[0], r[1]) for r in corpus]
    got = similarity.jaccard_groups(spark.read.parquet(files), reread=True).collect()
    assert Counter((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == Counter(brute(rows))
    got = boilerplate.dedup_lines(spark.read.parquet(files), reread=True, keep_first=False).collect()
    want = brute_lines(corpus, 5, False)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == want
    kept = [(r.doc_id, r.text) for r in similarity.first_of_groups(spark.read.parquet(files)).collect()]
    groups = brute(list(enumerate(t for _, t in rows)))  # ids repeat, places do not
    assert len(kept) == len({g for _, n, g in groups if n}) + sum(1 for _, n, _ in groups if not n)
    assert not Counter(kept) - Counter(rows)
    mixed = mixing.mix_sources(spark.read.parquet(files), reread=True).collect()
    assert len({r["__row"] for r in mixed}) == len(corpus)
    assert all(r["size"] == len((r.text or "").split()) for r in mixed)
    assert len(shifting) > 10
