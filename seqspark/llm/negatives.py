"""Hard negatives of anchor vectors: length buckets with sorted coordinate lists, feasible ranges, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_batches

BUCKET = 1 << 20  # components of all vectors of one bucket at most: 16,384 vectors of 64
CHUNK = 1 << 16  # components of the anchors that meet a bucket at a time, on average: 1,024 anchors of 64
SAMPLE = 1 << 18  # components of the vectors that first lower bounds are taken from: 4,096 vectors of 64
FOCUS = 4  # coordinates of an anchor whose lists are looked into
EXACT = 2.0**53  # up to here sums of products in double precision are exact
SLACK = 1e-9  # rounding of normalised values; ranges are wider by this


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) in double precision, which holds these whole numbers exactly."""
    return np.floor(256.0 * x.astype(np.float64)) + 0.0


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; beyond the long range they are cut to it."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if np.abs(q).max() * np.abs(p).max() * q.shape[1] < EXACT:
        return (q @ p.T).astype(np.int64)
    ints = [np.array([[int(v) for v in row] for row in x], object) for x in (q, p)]
    limit = 2**63 - 1
    return np.clip(ints[0] @ ints[1].T, -limit, limit).astype(np.int64)


def lengths(p: np.ndarray) -> np.ndarray:
    return np.sqrt((p * p).sum(1))


def sorted_lists(p: np.ndarray) -> np.ndarray:
    """For every coordinate the rows in the order of their normalised value (rows of length zero count as zero)."""
    return np.argsort(p / np.maximum(lengths(p), 1e-300)[:, None], axis=0, kind="stable").T.astype(np.int32)


class Bucket:
    """Vectors of close lengths, with the coordinate lists that were built when the index was written."""

    def __init__(self, record: dict):
        dim = record["dim"]
        self.row = np.frombuffer(record["rows"], np.int64)
        self.id = np.frombuffer(record["ids"], np.int64)
        self.null_id = np.frombuffer(record["null_ids"], bool)
        self.label = np.frombuffer(record["labels"], np.int64)
        self.p = np.frombuffer(record["vectors"], np.float64).reshape(-1, dim)
        self.longest = record["longest"]
        length = np.maximum(lengths(self.p), 1e-300)
        self.lists = np.frombuffer(record["lists"], np.int32).reshape(dim, -1)
        self.values = [self.p[o, f] / length[o] for f, o in enumerate(self.lists)]

    def candidates(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which vectors can reach score ``least`` with each anchor: a mask of anchors and vectors, never too small.

        A cosine of at least t = least / (length of the anchor * longest of the bucket) confines the normalised
        coordinate f of a vector to t*q_f +- sqrt((1-t^2)(1-q_f^2)); the ranges of the anchor's largest coordinates
        are looked up in their sorted lists and intersected. Anchors whose t exceeds 1 have none.
        """
        n = len(self.p)
        length = np.maximum(lengths(q), 1e-300)
        t = least / (length * max(self.longest, 1e-300))
        mask = np.ones((len(q), n), bool)
        mask[t > 1 + SLACK] = False
        mask[np.isnan(t)] = False
        open_ = np.flatnonzero((t > 0) & (t <= 1 + SLACK))
        if not len(open_):
            return mask
        unit = q[open_] / length[open_, None]
        t = np.minimum(t[open_], 1)[:, None]
        n_focus = min(FOCUS, q.shape[1])
        focus = np.argpartition(-np.abs(unit), n_focus - 1, axis=1)[:, :n_focus]
        own = np.take_along_axis(unit, focus, 1)
        half = np.sqrt((1 - t * t) * np.maximum(1 - own * own, 0)) + SLACK
        low, high = t * own - half, t * own + half
        high = np.where(own >= t - SLACK, 1 + SLACK, high)  # the vector may lie nearer to the axis than the anchor
        low = np.where(-own >= t - SLACK, -1 - SLACK, low)
        hits = np.zeros((len(open_), n), np.int8)
        for f in np.unique(focus):
            who, at = np.nonzero(focus == f)
            a = np.searchsorted(self.values[f], low[who, at], "left")
            b = np.searchsorted(self.values[f], high[who, at], "right")
            order = self.lists[f]
            for i, x, y in zip(who, a, b):
                if y - x == n:
                    hits[i] += 1
                else:
                    hits[i, order[x:y]] += 1
        mask[open_] = hits == n_focus
        return mask


def best(score: np.ndarray, id_: np.ndarray, null_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores first, then smaller ids (null ids last), then smaller rows."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((row[some], id_[some], null_id[some], -score[some]))][:k]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows sorted by (dim, length) into buckets of one dimension and at most BUCKET components."""
    held: list[tuple] = []

    def bucket() -> pa.RecordBatch:
        dim = held[0][0]
        p = np.concatenate([h[4] for h in held])
        columns = {
            "dim": [dim], "longest": [float(lengths(p).max())], "n": [len(p)], "rows": [np.concatenate([h[1] for h in held]).tobytes()],
            "ids": [np.concatenate([h[2][0] for h in held]).tobytes()], "null_ids": [np.concatenate([h[2][1] for h in held]).tobytes()],
            "labels": [np.concatenate([h[3] for h in held]).tobytes()], "vectors": [p.tobytes()], "lists": [np.ascontiguousarray(sorted_lists(p)).tobytes()],
            "bucket": [int(held[0][1][0])],
        }
        held.clear()
        return pa.RecordBatch.from_pydict(columns, schema=INDEX)

    for b in batches:
        dims = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(dims)) + 1
        for part in (b.slice(s, e - s) for s, e in zip([0, *cuts], [*cuts, b.num_rows])):
            while part.num_rows:
                dim = part.column(0)[0].as_py()
                have, most = sum(len(h[1]) for h in held), max(1, BUCKET // dim)
                if held and (held[0][0] != dim or have == most):
                    yield bucket()
                    have = 0
                take = part.slice(0, most - have)
                x = take.column(4).flatten().to_numpy(zero_copy_only=False).reshape(take.num_rows, dim)
                ids = take.column(2)
                numbers = (ids.fill_null(0).to_numpy(), np.array(ids.is_null()))
                held.append((dim, take.column(1).to_numpy(), numbers, take.column(3).to_numpy().astype(np.int64), whole(x)))
                part = part.slice(take.num_rows)
    if held:
        yield bucket()


INDEX = pa.schema(
    [("dim", pa.int32()), ("longest", pa.float64()), ("n", pa.int64()), ("bucket", pa.int64())]
    + [(c, pa.binary()) for c in ("rows", "ids", "null_ids", "labels", "vectors", "lists")]
)
INDEX_DDL = "dim int, longest double, n long, bucket long, rows binary, ids binary, null_ids binary, labels binary, vectors binary, lists binary"
HIT_DDL = "anchor_row long, part int, row long, id long, score long"


def _anchors(records: dict, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(records["vector"]), np.float64).reshape(-1, dim)


def _search(b: Bucket, chunk: dict, same_label: bool, k: int) -> Iterator[tuple]:
    """The bucket's first k rows for every range of every anchor of a chunk: (anchor row, range, row, id, score)."""
    q = _anchors(chunk, b.p.shape[1])
    rows, labels = np.array(chunk["row"], np.int64), np.array(chunk["label"], np.int64)
    ranges = chunk["ranges"]  # per anchor a list of (part, floor, ceiling) in hundredths of a score
    least = np.array([min((f for _, f, _ in r), default=np.inf) for r in ranges]) / 100
    mask = b.candidates(q, least)
    mask &= (labels[:, None] == b.label) if same_label else (labels[:, None] != b.label)
    if same_label:
        mask &= rows[:, None] != b.row
    dense = mask.sum() * 4 > mask.size
    all_scores = exact_products(q, b.p) if dense else None
    for i in np.flatnonzero(mask.any(1)):
        places = np.flatnonzero(mask[i])
        score = all_scores[i, places] if dense else exact_products(q[i : i + 1], b.p[places])[0]
        for part, floor, ceiling in ranges[i]:
            ok = (score >= -(-floor // 100)) & (score <= ceiling // 100)
            at = places[ok]
            for j in best(score[ok], b.id[at], b.null_id[at], b.row[at], k):
                p = at[j]
                yield int(rows[i]), part, int(b.row[p]), None if b.null_id[p] else int(b.id[p]), int(score[ok][j])


def _pack_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [whole(np.array(v.as_py(), np.float64)) for v in b.column(4)]
        size = [float(lengths(v[None])[0]) for v in x]
        columns = [*b.columns[:4], pa.array(size, pa.float64()), pa.array([v.tobytes() for v in x], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "dim", "length", "vector"])


LOWEST, HIGHEST = -(2**62), 2**62  # in hundredths of a score: below and above every score that is told apart


def _search_all(index: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """All anchors against all buckets, in blocks: a bucket's record comes first, then the chunks of anchors one by one.

    Each bucket stays whole in one task and sees one chunk of at most CHUNK anchors at a time. Chunks go only to
    buckets of their dimension that are long enough for their least score, so short vectors are pruned unread.
    """
    chunked = anchors.groupBy("dim", "chunk").agg(
        F.collect_list(F.struct("row", "label", "ranges", "vector", "reach")).alias("a"), F.min("reach").alias("reach")
    )
    chunked = keep(chunked, "anchor-chunks")
    bounds = index.select("bucket", "dim", "longest")
    pairs = bounds.join(chunked.select("dim", "chunk", "reach"), "dim").where(F.col("longest") * (1 + SLACK) + SLACK >= F.col("reach"))
    names = INDEX.names
    none = [F.lit(None).cast("array<struct<row:long,label:long,ranges:array<struct<part:int,low:long,high:long>>,vector:binary,reach:double>>").alias("a")]
    first = index.select(*names, F.lit(-1).cast("long").alias("chunk"), *none)
    then = pairs.select("bucket", "dim", "chunk").join(chunked.select("dim", "chunk", "a"), ["dim", "chunk"])
    empty = [F.lit(None).cast(t).alias(c) for c, t in index.dtypes if c not in ("bucket", "dim")]
    then = then.select(*empty, "bucket", "dim", "chunk", "a").select(*names, "chunk", "a")
    both = first.unionByName(then).repartition("bucket").sortWithinPartitions("bucket", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] < 0:
                    b = Bucket(r)
                    continue
                chunk = {c: [x[c] for x in r["a"]] for c in ("row", "label", "vector")}
                chunk["ranges"] = [[(x["part"], x["low"], x["high"]) for x in a["ranges"]] for a in r["a"]]
                found = list(zip(*_search(b, chunk, same_label, k)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["anchor_row", "part", "row", "id", "score"],
                    )

    with small_batches(index.sparkSession, 1):
        found = keep(both.mapInArrow(run, HIT_DDL), "hits")
    order = Window.partitionBy("anchor_row", "part").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _raised(anchors: DataFrame, sample: list, same_label: bool, k: int) -> DataFrame:
    """Raise the floor of every range to the k-th best score that a sample of all rows already reaches in it."""
    if not sample:
        return anchors
    by_dim = {}
    for r in sample:
        by_dim.setdefault(len(r["embedding"]), []).append(r)
    tables = {d: (np.array([r["row"] for r in s]), np.array([r["label"] for r in s]), whole(np.array([r["embedding"] for r in s], np.float64))) for d, s in by_dim.items()}
    shared = anchors.sparkSession.sparkContext.broadcast(tables)  # SAMPLE vectors at most
    names, ddl = anchors.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for d in {r["dim"] for r in out} & set(shared.value):
                own = [r for r in out if r["dim"] == d]
                s_row, s_label, s = shared.value[d]
                scores = exact_products(np.frombuffer(b"".join(r["vector"] for r in own), np.float64).reshape(-1, d), s)
                for r, score in zip(own, scores):
                    fits = (s_label == r["label"]) & (s_row != r["row"]) if same_label else s_label != r["label"]
                    for x in r["ranges"]:
                        v = score[fits & (score <= x["high"] // 100)]
                        if len(v) >= k:
                            x["low"] = max(x["low"], 100 * int(np.partition(v, len(v) - k)[len(v) - k]))
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return anchors.mapInArrow(run, ddl).select(*names)


def _with_reach(anchors: DataFrame) -> DataFrame:
    """The length a vector needs to reach an anchor's least floor; anchors without ranges are left out."""
    lowest = F.array_min(F.transform("ranges", lambda r: r["low"])) / 100
    reach = F.when(lowest <= 0, F.lit(0.0)).otherwise(lowest / F.greatest("length", F.lit(1e-300)))
    return anchors.where(F.size("ranges") > 0).withColumn("reach", reach)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """Per anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id and both scores.

    Components count as floor(256 * x); a score is the whole-number inner product with the anchor, exact (beyond 64
    bits it is cut to the largest long). Positives are the first ``n_positives`` other rows of the anchor's label,
    negatives the first ``n_negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive;
    higher scores come first, ties by smaller key (null keys last), then by the place of the row. ``label`` must be a
    whole number.

    Rows with a null label, a null or empty vector, or null or non-finite components take no part; vectors of another
    length than the anchor's are not compared with it; rows of zeros are (score 0). ``is_anchor`` is a condition on the
    input; null counts as no. Repeated rows are rows of their own, so a repeated anchor has its rows repeated. An
    anchor without positives, or a positive without negatives in range, gives no row; an empty table gives none.
    Other columns are not carried.

    Every vector is indexed. Rows are ranged by dimension and length into buckets of at most BUCKET rows that hold
    one sorted list per coordinate. A bounded sample (SAMPLE rows) gives every anchor a first lower bound of what it
    needs; buckets and coordinate ranges that cannot reach it are pruned, candidates in all focus ranges are scored
    exactly. The sample only prunes: it can raise a floor to a score that enough rows reach for certain.
    """
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & (F.size(embedding) > 0) & ~bad)
    rows = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.size(embedding).alias("dim"),
    )
    about = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = keep(rows.withColumn("about", about).withColumn("row", F.monotonically_increasing_id()), "vectors")

    sorted_rows = rows.repartitionByRange("dim", "about", "row").sortWithinPartitions("dim", "about", "row")
    index = keep(sorted_rows.select("dim", "row", "id", "label", "embedding").mapInArrow(_pack, INDEX_DDL), "length-buckets")

    widest = rows.agg(F.max("dim")).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("row")).limit(max(1, SAMPLE // widest)).select("row", "label", "embedding").collect()
    picked = rows.where("is_anchor")
    counts = picked.groupBy("dim").agg(F.ceil(F.count("*") * F.first("dim") / CHUNK).cast("long").alias("chunks"))
    packed = picked.select("row", "id", "label", "dim", "embedding").mapInArrow(_pack_anchors, "row long, id long, label long, dim int, length double, vector binary")
    anchors = packed.join(counts, "dim").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("long")).drop("chunks")
    anchors = keep(anchors, "anchors")

    def range_(part, lowest, highest):
        return F.struct(part.cast("int").alias("part"), lowest.cast("long").alias("low"), highest.cast("long").alias("high"))

    wide = anchors.withColumn("ranges", F.array(range_(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST))))
    wide = _with_reach(_raised(wide, sample, True, n_positives))
    positives = keep(_search_all(index, wide, True, n_positives).select("anchor_row", "rank", "id", "score"), "positives")

    usable = positives.where(F.col("score") * low <= F.col("score") * high)
    floors = usable.groupBy(F.col("anchor_row").alias("row")).agg(
        F.collect_list(range_(F.col("rank"), F.col("score") * low, F.col("score") * high)).alias("ranges")
    )
    narrow = _with_reach(_raised(anchors.join(floors, "row"), sample, False, n_negatives))
    negatives = _search_all(index, narrow, False, n_negatives)
    named = negatives.select("anchor_row", F.col("part"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    facts = positives.select("anchor_row", F.col("rank").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return named.join(facts, ["anchor_row", "part"]).join(ids, "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
