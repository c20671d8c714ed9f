import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspark.llm import passages
from seqspark.llm.passages import PASSAGE, WIDTH, encode, fit, fit_quality, held_out, score_quality, score_texts


def bytes_of(texts):
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *[len(d) for d in data]])[:-1]
    return np.frombuffer(b"".join(data), np.uint8), starts


def test_batches_and_single_texts_give_equal_features():
    rng = random.Random(1)
    texts = ["", " \n", "one", "One one, two!", "é ü " * 100] + [" ".join(rng.choice(["a", "bb.", "CC", "d1"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    x, owner = encode(*bytes_of(texts))
    assert x.shape[1] == WIDTH
    for i, t in enumerate(texts):
        own, _ = encode(*bytes_of([t]))
        assert len(own) == max(1, -(-len(t.split()) // PASSAGE))
        assert np.allclose(x[owner == i], own, atol=1e-6)


def test_word_features_by_hand():
    x, _ = encode(*bytes_of(["aa aa bb aa. Cc"]))
    names = dict(zip(("length", "spread", "again", "repeated", "capital", "mark", "single"), x[0, -9:]))
    assert names["again"] == pytest.approx(1 / 5) and names["repeated"] == pytest.approx(1 / 5)
    assert names["capital"] == pytest.approx(1 / 5) and names["mark"] == pytest.approx(1 / 5) and names["single"] == 0
    assert names["length"] == pytest.approx(11 / 5 / 8)


def test_attention_finds_the_passage_that_decides():
    """Label 0 if any passage is bad: the mean of passages hides it, the gate must weigh it up."""
    rng = np.random.default_rng(0)
    x, owner, y = [], [], []
    for d in range(600):
        own = rng.standard_normal((rng.integers(4, 12), WIDTH)) * 0.1
        y.append(d % 2)
        if not d % 2:
            own[rng.integers(len(own)), :3] += 1
        x.append(own)
        owner.append(np.full(len(own), d))
    x, owner, y = np.concatenate(x).astype(np.float32), np.concatenate(owner), np.array(y)
    model = fit(x, owner, y, rounds=40)
    h, e = model.passages(x)
    right = 0
    for d in range(600):
        w = np.exp(e[owner == d] - e[owner == d].max())
        right += (model.answer((w / w.sum()) @ h[owner == d]) >= 0.5) == y[d]
        if not y[d]:
            bad = x[owner == d][:, :3].sum(1).argmax()
            assert w[bad] / w.sum() > 0.15
    assert right > 570


def docs(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        good = i % 5 != 0
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        if i % 3:
            labels.append((i, int(good)))
    rows += [(None, "a b"), (7, rows[7][1]), (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "word " * 300_000), (n + 4, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash")).withColumn("Predicted", F.lit(1))
    return df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_edges(spark):
    df, labels = docs(spark)
    got = score_quality(df, fit_quality(df, labels)).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 0) for r in known) >= 0.97 * len(known)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (400, 401)}) == 1


def test_held_out_labels_are_never_read(spark):
    df, labels = docs(spark)
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_quality(df, labels), fit_quality(df, other)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_long_texts_are_read_whole(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["ab", "cde", "fgh!"], 3 * PASSAGE * 20))
    x, owner = encode(*bytes_of([text, "aa bb"]))
    model = fit(np.concatenate([x, -x]), np.concatenate([owner, owner + 2]), np.array([1, 1, 0, 0]), rounds=3)
    whole, n = score_texts(model, pa.array([text.encode(), b"aa bb"], pa.large_binary()))
    h, e = model.passages(x[owner == 0])
    w = np.exp(e - e.max())
    assert whole[0] == pytest.approx(float(model.answer(w @ h / w.sum())[0]), abs=1e-4)
    monkeypatch.setattr(passages, "SLAB", 5000)
    sliced, m = score_texts(model, pa.array([text.encode(), b"aa bb"], pa.large_binary()))
    assert m[0] >= n[0] == 60 and m[1] == 1
    assert sliced[1] == pytest.approx(whole[1], abs=1e-6) and sliced[0] == pytest.approx(whole[0], abs=0.05)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in score_quality(df, fit_quality(df, none)).collect()] == [0.5]
    one = fit_quality(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert 0.5 < score_quality(df, one).first()["score"] < 1
    assert score_quality(df.limit(0), one).collect() == []
