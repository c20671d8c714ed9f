"""Embedding near-dedup with an inverted multi-index over the two halves of unit vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

SAMPLE = 8192  # vectors that codebooks and the number of visited cells are fitted on
BLOCK = 4096  # vectors of one side that a task multiplies at a time


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for j in range(len(centres)):
            own = x[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


class MultiIndex:
    """Codebooks of both halves; their product is a grid of cells."""

    def __init__(self, x: np.ndarray, k: int, cosine: float, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.half = x.shape[1] // 2
        self.books = [kmeans(h, k, rng) for h in (x[:, : self.half], x[:, self.half :])]
        self.k = len(self.books[0])
        # a neighbour at exactly the threshold, in a random direction, is the hardest that must be found
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        partner = cosine * x + math.sqrt(1 - cosine * cosine) * noise
        home = self.visit(partner, 1)[:, 0]
        self.cells = self.k * self.k
        most = min(self.cells, 256)
        seen = self.visit(x, most) == home[:, None]
        rank = np.where(seen.any(1), seen.argmax(1), most)
        self.visits = int(min(most, np.quantile(rank, recall) + 1)) if len(rank) else 1

    def visit(self, x: np.ndarray, n: int) -> np.ndarray:
        """Multi-sequence traversal: the n cells with the smallest sums of distances, nearest first.

        Cell (a, b) in order of its halves' ranks comes after (a + 1) * (b + 1) - 1 others, so only ranks under that
        hyperbola are looked at.
        """
        distance = [((b**2).sum(1) - 2 * h @ b.T) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books)]
        order = [np.argsort(d, axis=1, kind="stable") for d in distance]
        ranks = [(a, b) for a in range(min(n, order[0].shape[1])) for b in range(min(n // (a + 1), order[1].shape[1]))]
        ra, rb = np.array([a for a, _ in ranks]), np.array([b for _, b in ranks])
        rows = np.arange(len(x))[:, None]
        ca, cb = order[0][:, ra], order[1][:, rb]
        total = distance[0][rows, ca] + distance[1][rows, cb]
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        return (ca * len(self.books[1]) + cb)[rows, best]


def near_pairs(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Distinct valid vectors, and the pairs of them with one label and at least this cosine.

    ``vectors``: __row, label, embedding. Returns classes (node, label, embedding, copies) and pairs (a, b) of nodes.
    Equal vectors of one label are one node. Codebooks and the number of visited cells are fitted on at most SAMPLE
    vectors (those with the smallest hashes); every vector is indexed and every vector searches. The cells of a
    half grow with the root of the number of vectors, at most SAMPLE / 16, so a cell and label keeps a few dozen
    vectors; a fuller one is multiplied block by block.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    valid = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(False)) & some)
    # -0.0 and 0.0 are one value
    valid = valid.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0).cast("float")))
    classes = valid.groupBy("label", "embedding").agg(F.min("__row").alias("node"), F.count("*").alias("copies"))
    classes = keep(classes.withColumn("dim", F.size("embedding")), "vectors")
    counts = [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    pairs = None
    for dim, n in sorted(counts):
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("node")).select("embedding").limit(SAMPLE).collect()
        x = np.array([r[0] for r in sample], np.float64).reshape(-1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = int(min(SAMPLE // 16, max(1, math.isqrt(n // 48) + 1)))
        found = _search(own, MultiIndex(x, k, cosine, recall, seed), cosine)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = vectors.sparkSession.createDataFrame([], "a long, b long")
    return classes, keep(pairs.distinct(), "vector-pairs")


def _search(own: DataFrame, index: MultiIndex, cosine: float) -> DataFrame:
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            cells = index.visit(x / np.linalg.norm(x, axis=1, keepdims=True), index.visits)
            n, at = cells.shape[1], pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            home = np.tile(np.arange(n) == 0, batch.num_rows)
            columns = [c.take(at) for c in batch.columns] + [pa.array(cells.ravel()), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "embedding", "cell", "home"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    placed = own.select("node", "label", "embedding").mapInArrow(
        place, f"node long, label {kinds['label']}, embedding {kinds['embedding']}, cell long, home boolean"
    )
    # cells that no vector calls home need no visitors; full ones are cut into blocks of homes, each with all visitors
    full = placed.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    both = placed.join(full, ["label", "cell"])
    blocks = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))).otherwise(F.array().cast("array<int>"))
    both = both.withColumn("own", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumn("home", F.array_contains("own", F.col("block")))

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["embedding"].to_list(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        node, home = part["node"].to_numpy(), part["home"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(x), 1024):
            p, q = np.nonzero(x[i : i + 1024] @ x[home].T >= cosine)
            p, q = node[i : i + 1024][p], node[home][q]
            a.append(np.minimum(p, q))
            b.append(np.maximum(p, q))
        found = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
        return found[found["a"] != found["b"]].drop_duplicates()

    groups = both.select("label", "cell", "block", "node", "home", "embedding").groupBy("label", "cell", "block")
    return groups.applyInPandas(multiply, "a long, b long")


def dedup_vectors(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: key, n_links (other vectors linked directly), component_id and kept (key = component_id).

    Vectors with one label that is not null are linked at this cosine or more, in double precision. Null, zero and
    empty vectors, and those with null or non-finite components, are linked with nothing; vectors of different
    lengths are never linked. Equal vectors are linked with each other and counted each; a null key is carried, never
    kept, and never the id of others; repeated rows are separate vectors; an empty table gives no rows; other columns
    are not carried.
    """
    rows = vectors.select(F.col(key).alias("__key"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = keep(rows.withColumn("__row", F.monotonically_increasing_id()), "vector-rows")
    classes, pairs = near_pairs(rows.select("__row", "label", "embedding"), cosine)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    facts = classes.join(partners, "node", "left").join(components(pairs), "node", "left")
    facts = facts.select(
        "label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    plain = F.transform("embedding", lambda v: v + F.lit(0).cast("float"))
    named = rows.withColumn("embedding", plain).join(facts, ["label", "embedding"], "left")
    named = keep(named.select("__key", "n_links", "component"), "vector-links")
    ids = named.where("component is not null").groupBy("component").agg(F.min("__key").alias("component_id"))
    joined = named.join(ids, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("__key")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("__key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("__key") == component, F.lit(False)).alias("kept"),
    )
