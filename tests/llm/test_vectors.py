import numpy as np
from pyspark.sql import functions as F

from seqspark.llm.vectors import MultiIndex, dedup_vectors, near_pairs

DDL = "vec_id long, embedding array<float>, label int"


def unit(rng, n, d):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(seed=0, n=500, d=16):
    rng = np.random.default_rng(seed)
    base = unit(rng, n, d)
    near = base[: n // 2] + rng.standard_normal((n // 2, d)) * rng.choice([0.01, 0.04, 0.055], (n // 2, 1))
    x = np.concatenate([base, near, base[:20], base[:20] * 3]).astype(np.float32)
    return x, rng.integers(0, 3, len(x))


def brute(x, labels):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def test_recall_and_no_false_link(spark):
    x, labels = clusters()
    near = brute(x, labels)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))], DDL).withColumn("node", F.lit(1))
    _, pairs = near_pairs(df.select(F.col("vec_id").alias("__row"), "label", "embedding"))
    pairs = {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(near[a, b] for a, b in pairs)
    got = {r["vec_id"]: r for r in dedup_vectors(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * near.sum()
    assert all(r["n_links"] <= near[i].sum() for i, r in got.items())
    for i, r in got.items():
        assert r["component_id"] <= i and r["kept"] == (r["component_id"] == i)


def test_tight_groups_are_found_whole(spark):
    rng = np.random.default_rng(3)
    base = unit(rng, 40, 8)
    x = np.repeat(base, 5, axis=0) + rng.standard_normal((200, 8)) * 1e-3
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(200)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dedup_vectors(spark.createDataFrame(rows, DDL)).collect()}
    near = brute(x.astype(np.float32), np.ones(200))
    assert got == {i: (near[i].sum(), i // 5 * 5) for i in range(200)}


def test_edges(spark):
    v = [1.0, 2.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1),
        (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [2.0, 4.0], 1), (12, [1.0, 2.0, 0.0], 1), (None, v, 1), (13, [-0.0, 1.0], 3),
        (14, [0.0, 1.0], 3),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in dedup_vectors(spark.createDataFrame(rows, DDL)).collect()}
    want = {i: (0, i, True) for i in range(1, 15)}
    want |= {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False), None: (3, 1, False), 13: (1, 13, True), 14: (1, 13, False)}
    assert got == want


def test_no_rows(spark):
    assert dedup_vectors(spark.createDataFrame([], DDL)).collect() == []


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(4)
    x = unit(rng, 300, 6)
    index = MultiIndex(x, 7, 0.98, 0.9, 1)
    halves = [((h[:, None, :] - b[None]) ** 2).sum(2) for h, b in zip((x[:, :3], x[:, 3:]), index.books)]
    grid = (halves[0][:, :, None] + halves[1][:, None, :]).reshape(300, -1)
    seen = index.visit(x, 10)
    assert np.allclose(np.take_along_axis(grid, seen, 1), np.sort(grid, axis=1)[:, :10])
