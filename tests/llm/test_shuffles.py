import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqspark.llm.draws import even, hypergeometric, matrix, split, tree
from seqspark.llm.mixing import mix_plan, mix_sources, share_out
from seqspark.llm.sharding import uniform_shards


def test_hypergeometric_follows_its_law():
    rng = random.Random(1)
    got = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(20000))
    from math import comb

    for k in range(6):
        assert abs(got[k] / 20000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015
    assert hypergeometric(rng, 10**10, 10**11, 10**9) > 0


def test_matrices_keep_their_sums():
    rng = random.Random(2)
    m = matrix(rng, [50, 0, 7, 143], even(200, 6))
    assert [sum(r) for r in m] == [50, 0, 7, 143] and [sum(c) for c in zip(*m)] == even(200, 6)
    t = tree(rng, [90, 3, 0, 7], even(100, 8))
    assert [sum(r) for r in t] == [90, 3, 0, 7] and [sum(c) for c in zip(*t)] == even(100, 8)
    assert sum(split(rng, [3, 4, 5], 6)) == 6


def slots_are_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return Counter({k: len(v) for k, v in by.items()})


def test_shards_have_exact_sizes_and_all_rows(docs, corpus):
    got = uniform_shards(docs, 7).collect()
    sizes = slots_are_gapless(got)
    assert len(got) == len(corpus) and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in corpus)
    again = uniform_shards(docs, 7).collect()
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in again}


def test_every_row_may_go_anywhere(spark):
    df = spark.range(4000).repartition(5)
    got = uniform_shards(df, 4).collect()
    assert set(slots_are_gapless(got).values()) == {1000}
    low = Counter(r["shard"] for r in got if r["id"] < 2000)
    assert all(420 < low[s] < 580 for s in range(4))
    first = sum(r["slot"] < 500 for r in got if r["id"] < 2000)
    assert 900 < first < 1100


def test_equal_and_null_rows_spread(spark):
    df = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert set(slots_are_gapless(uniform_shards(df, 9).collect()).values()) == {100}


def test_no_rows(no_docs):
    assert uniform_shards(no_docs).collect() == [] and mix_sources(no_docs).collect() == []


def test_shares():
    assert share_out([10, 100, 1000], [5, 2, 1], 1665) == pytest.approx([20, 200, 1445])
    assert share_out([100, 100], [1, 1], 300) == pytest.approx([150, 150])
    assert share_out([], [], 0) == [] and share_out([0, 5], [5, 2], 7.5) == pytest.approx([0, 7.5])


def test_mix_meets_its_targets(docs, corpus):
    got = mix_sources(docs, shards=4).collect()
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(k for k in sizes if k is not None) + [None]
    want = dict(zip(order, share_out([sizes[k] for k in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    taken, rows = Counter(), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["words"] <= r["size"] and (r["words"] > 0) == (r["shard"] is not None)
        taken[r["source"]] += r["words"]
        rows.setdefault(r["__row"], []).append(r)
    assert len(rows) == len(corpus)
    assert all(abs(taken[k] - want[k]) <= 0.5 for k in order)
    assert all(sum(r["words"] for r in v) <= 2 * v[0]["size"] and len({r["copy"] for r in v}) == len(v) for v in rows.values())
    shards = slots_are_gapless([r for r in got if r["shard"] is not None])
    assert max(shards.values()) - min(shards.values()) <= 1
    again = mix_sources(docs, shards=4).collect()
    assert sorted((r["__row"], r["copy"], r["words"], r["shard"], r["slot"]) for r in got if r["words"]) == sorted(
        (r["__row"], r["copy"], r["words"], r["shard"], r["slot"]) for r in again if r["words"]
    )


def test_a_source_of_one_long_document(spark):
    df = spark.createDataFrame([(1, "w " * 9000, "a"), (2, "v " * 100, "b"), (3, None, "b"), (4, "", None)], "doc_id long, text string, source string")
    plan, _ = mix_plan(df)
    got = {r["doc_id"]: r["taken"] for r in plan.collect()}
    assert got == {1: 13450, 2: 200, 3: 0, 4: 0}
