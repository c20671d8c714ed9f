import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import negatives
from seqspark.llm.negatives import Bucket, exact_products, mine_negatives, whole

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, n=5, low=80, high=100):
    """Plain loops over Python whole numbers; ties by id (null last), then by place."""
    valid = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v], lab) for i, v, lab in rows
             if lab is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for k, (a, q, la) in enumerate(valid):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), i is None, i or 0, i, lab) for j, (i, p, lab) in enumerate(valid) if j != k and len(p) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == la][:n]:
            ok = [s for s in scored if s[4] != la and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:n]
            out += [(a, p[3], r + 1, s[3], -p[0], -s[0]) for r, s in enumerate(ok)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame(rows, DDL).repartition(3).withColumn("row", F.lit("clash")).withColumn("dim", F.lit(1.5))
    got = mine_negatives(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(seed, n, d, labels):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    x = centres[rng.integers(0, 8, n)] + 0.4 * rng.standard_normal((n, d))
    x *= rng.lognormal(0, 1, n)[:, None]  # lengths that differ: short vectors are pruned by their bucket
    return [(i * 20, [float(c) for c in np.float32(v)], int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("d", "labels"), [(8, 3), (1, 2), (24, 5)])
def test_equals_brute_force(spark, d, labels):
    rows = clustered(d, 400, d, labels)
    assert mined(spark, rows) == brute(rows)


def test_small_buckets_and_chunks(spark, monkeypatch):
    rows = clustered(1, 300, 6, 3)
    monkeypatch.setattr(negatives, "CHUNK", 60)
    monkeypatch.setattr(negatives, "SAMPLE", 120)
    assert mined(spark, rows) == brute(rows)


def test_copies_ties_nulls_and_odd_vectors(spark):
    v, w = [1.0, 2.0], [2.0, 1.0]
    rows = [(i, v, 1) for i in range(1, 60)] + [(100, v, 1), (200, w, 2), (None, w, 2), (300, [0.0, 0.0], 1), (400, [-1.0, -1.0], 2)]
    rows += [(500, None, 1), (600, [], 1), (700, [1.0, None], 1), (800, [float("nan"), 1.0], 1), (900, [float("inf"), 1.0], 1), (1000, v, None)]
    rows += [(1100, [1.0, 2.0, 3.0], 1), (1201, [1.0, 2.0, 2.5], 2), (1203, [1.0, 2.0, 3.5], 1), (None, v, 1), (1300, [3e38, 1.0], 1)]
    rows += [(60 + i, [1.0, 1.5], 3) for i in range(30)]
    got, want = mined(spark, [r for r in rows if r[0] != 1300]), brute([r for r in rows if r[0] != 1300])
    assert got == want and any(r[0] == 1100 for r in got)
    assert mined(spark, rows)  # scores beyond the long range are cut, without an error


def test_repeated_anchor(spark):
    rows = [(100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [1.0, 0.8], 2)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_candidates_never_miss_and_do_prune():
    rng = np.random.default_rng(2)
    p = whole(rng.standard_normal((800, 12)) * rng.lognormal(0, 0.2, 800)[:, None])
    q = whole(rng.standard_normal((40, 12)))
    record = {
        "dim": 12, "rows": np.arange(800).tobytes(), "ids": np.arange(800).tobytes(), "null_ids": np.zeros(800, bool).tobytes(), "labels": np.zeros(800, np.int64).tobytes(),
        "vectors": p.tobytes(), "longest": float(negatives.lengths(p).max()), "lists": np.ascontiguousarray(negatives.sorted_lists(p)).tobytes(),
    }
    scores = exact_products(q, p)
    for share in (-0.5, 0.0, 0.3, 0.8, 1.2):
        least = share * negatives.lengths(q) * record["longest"]
        mask = Bucket(record).candidates(q, least)
        assert mask[scores >= least[:, None]].all()
        if share >= 0.8:
            assert mask.mean() < 0.3
