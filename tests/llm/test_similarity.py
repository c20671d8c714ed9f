import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import similarity
from seqspark.llm.components import components
from seqspark.llm.shingles import shingle_sets
from seqspark.llm.similarity import Tree, bitmaps, jaccard_groups, linked, prefix, signature, traverse, tree_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return sorted(((str(r[0]), len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_groups_are_those_of_all_pairs(docs, corpus):
    got = sorted(((str(r[0]), r[1], r[2]) for r in jaccard_groups(docs).collect()), key=str)
    assert got == brute(corpus)


def test_a_family_whose_members_differ_from_the_first(spark, words):
    """A chain: each text is like the next, not like the first; common shingles and trees must still link it."""
    base = [words[i % 400] + str(i) for i in range(160)]
    rows = [(i, " ".join(base[i * 6 : i * 6 + 60]) if i < 16 else f"alone {i} " + " ".join(base[:20])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((str(r[0]), r[1], r[2]) for r in jaccard_groups(df).collect()), key=str) == brute(rows)


def test_no_rows(no_docs):
    assert jaccard_groups(no_docs).collect() == []


def test_sets_have_the_sizes_of_the_definition():
    texts = ["", None, "a", "A b", "a b c d e", "a b c d e f", "x y z x y z x y z x", "é é b\x0bc\x0cd e f"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_linked_sets_share_a_prefix_token_under_any_order():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        common = np.sort(rng.choice(a, len(a) // 2, replace=False))
        if linked(len(np.intersect1d(a, b)), len(a), len(b)):
            p, q = (np.concatenate(prefix(s, common)) for s in (a, b))
            assert len(np.intersect1d(p, q))


def test_traversal_never_loses_a_linked_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(20, 200)), dtype=np.uint64))
        sets += [a] + [np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(0, 2**63, 8, dtype=np.uint64)])) for keep in (0.95, 0.85, 0.8)]
    sets.sort(key=len)
    sigs = [signature(s) for s in sets]
    maps = bitmaps(sigs, min(map(len, sigs)) // 8)
    n, comp = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = Tree(n, maps, comp)
    found = set(zip(*(x.tolist() for x in traverse(tree, tree))))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert want and want <= found and len(found) < len(sets) ** 2 / 8
    other = Tree(n[1:], maps[1:], comp[1:])
    cross = set(zip(*(x.tolist() for x in traverse(tree, other))))
    assert want <= {(i, j + 1) for i, j in cross}


def test_blocks_of_a_group_meet_completely(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    rows = [(1, i, i % 9, len(s), signature(s)) for i in range(60) for s in [base[rng.random(len(base)) < 0.97]]]
    df = spark.createDataFrame([(g, n, c, k, bytearray(s)) for g, n, c, k, s in rows], "grp long, node long, comp long, n long, sig binary")
    meetings = tree_pairs(df.drop("sig"), df.select("node", "sig")).collect()
    got = [(min(x, y), max(x, y)) for r in meetings for x, y in zip(r["x"], r["y"])]
    assert len(meetings) > 50 and len(got) == len(set(got))
    assert set(got) == {(i, j) for j in range(60) for i in range(j) if i % 9 != j % 9}
    assert all(c == x % 9 and d == y % 9 for r in meetings for x, y, c, d in zip(r["x"], r["y"], r["cx"], r["cy"]))



@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            x, y = want.get(a, a), want.get(b, b)
            want |= {a: x, b: y}
            want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == want


def test_repeated_rows_fall_together(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.lit("the same few words in all of the rows").alias("text"))
    assert {tuple(r) for r in jaccard_groups(df).collect()} == {(0, 5, 0), (1, 5, 0), (2, 5, 0)}
