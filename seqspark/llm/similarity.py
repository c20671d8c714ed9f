"""N-gram Jaccard join: prefix tokens say which texts may meet, signature trees prune what meets, sets decide.

Notation: a *set* is a text's distinct 5-word shingles (hashes); a *node* stands for all rows with one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_batches, with_row
from .components import components
from .shingles import overlap, set_key, shingle_sets

#: Similarity of 3/4 in whole numbers: linked when UP * intersection >= LOW * union.
UP, LOW = 4, 3
COMMON_SHARE = 2000  # a shingle in more than one of so many sets is common
FLUSH = 2_000_000  # shingles that a task counts at a time
BLOCK = 512  # rows of one side of a signature-tree task
FANOUT = 8
BLOCK_SHINGLES = 400_000  # and shingles of its sets
STAR = 1024  # rows with one hub that a task verifies
FEW = 2_000_000  # row numbers that may be broadcast to pick rows out: 16 MB


def linked(common: int, a: int, b: int) -> bool:
    return bool(a and b and UP * common >= LOW * (a + b - common))


def least_overlap(n: int) -> int:
    """The smallest intersection with which a set of n can be linked to any other."""
    return -(-LOW * n // UP)


def common_shingles(docs: DataFrame, n_rows: int, text: str) -> np.ndarray:
    """Hashes of shingles found in more than one of COMMON_SHARE rows, sorted.

    Every row is counted, in portions of FLUSH shingles; what a portion holds less than three times is not passed on,
    so counts may be low. Their only use is an order of shingles, and any order gives the same links. At most
    COMMON_SHARE times the mean set size can be common, whatever the number of rows: some megabytes at the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = shingle_sets(batch.column(0)[i : i + 256].to_pylist())
                waiting += sets
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield flush()
                    waiting, size = [], 0
        yield flush()

    counts = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = counts.where(F.col("n") > max(8, n_rows // COMMON_SHARE)).select("token").collect()
    return np.sort(np.array([r[0] for r in heavy], np.int64).view(np.uint64))


def prefix(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one of which every linked set shares: rare ones first, by hash, then common ones.

    Under any global order, linked sets share one of the first n - least_overlap(n) + 1 tokens.
    """
    p = len(s) - least_overlap(len(s)) + 1 if len(s) else 0
    if not len(common):
        return s[:p], s[:0]
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    is_common = common[at] == s
    rare = s[~is_common][:p]
    return rare, s[is_common][: p - len(rare)]


def describe(docs: DataFrame, common: np.ndarray, text: str) -> DataFrame:
    """Per row (``__row`` and ``__key`` are carried) n and key of the set; at the set's first row in a task also its prefix and signature."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        for batch in batches:
            out = {"n": [], "set": [], "rare": [], "common": [], "sig": []}
            for i in range(0, batch.num_rows, 256):
                for s in shingle_sets(batch.column(2)[i : i + 256].to_pylist()):
                    key = set_key(s)
                    out["n"].append(len(s))
                    out["set"].append(key)
                    first = len(s) > 0 and key not in seen
                    rare, often = prefix(s, common) if first else (None, None)
                    out["sig"].append(signature(s) if first else None)
                    out["rare"].append(None if rare is None else rare.view(np.int64))
                    out["common"].append(None if often is None else often.view(np.int64))
                    seen.add(key)
                    if len(seen) > 500_000:  # a set seen again is only described again
                        seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["n"], pa.int64()), pa.array(out["set"], pa.binary()),
                 pa.array(out["rare"], pa.list_(pa.int64())), pa.array(out["common"], pa.list_(pa.int64())), pa.array(out["sig"], pa.binary())],
                names=["__row", "__key", "n", "set", "rare", "common", "sig"],
            )

    kind = docs.schema["__key"].dataType.simpleString()
    rows = docs.select("__row", "__key", text).mapInArrow(
        run, f"__row long, __key {kind}, n long, set binary, rare array<long>, common array<long>, sig binary"
    )
    return keep(rows, "sets")


def picked(df: DataFrame, on: str, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of a wide table with row numbers: a broadcast if these are FEW, counted, else a shuffle of both."""
    few = rows.count() <= FEW
    return df.join(F.broadcast(rows) if few else rows, on, how)


def firsts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One described row per node. Described rows that are not their node's (copies in other tasks) are left out."""
    described = rows.where("rare is not null")
    extra = described.select("set", "__row").join(nodes.select("set", "node"), "set").where(F.col("__row") != F.col("node"))
    extra = keep(extra.select("__row"), "copies")
    return picked(described, "__row", extra, "left_anti").withColumnRenamed("__row", "node")


def shared_tokens(first: DataFrame) -> DataFrame:
    """(token, node, low, high, k) of every prefix token that k > 1 nodes have; low and high are its end nodes.

    Rare tokens meet in one task per token, as their number of sets is bounded by the order; common ones may be in
    any share of all sets, so their ends are found by an aggregation that combines before the shuffle.
    """
    by_token = Window.partitionBy("token")
    rare = first.select(F.explode("rare").alias("token"), "node")
    rare = rare.select("token", "node", F.min("node").over(by_token).alias("low"), F.max("node").over(by_token).alias("high"), F.count("*").over(by_token).alias("k"))
    common = first.select(F.explode("common").alias("token"), "node")
    ends = common.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("k"))
    common = common.join(ends, "token").select("token", "node", "low", "high", "k")
    return keep(rare.where("low <> high").unionByName(common.where("low <> high")), "tokens")


def signature(s: np.ndarray) -> bytes:
    """Token bitmap of a set: a power of two of bits, one to two per token, by the hash's lowest bits."""
    bits = max(256, 1 << len(s).bit_length())
    mark = np.zeros(bits, np.uint8)
    mark[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark, bitorder="little").tobytes()


def enough(common_bits: np.ndarray, spare: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether the largest possible overlap suffices: linked sets share 3/7 of the sum of their sizes or more.

    Tokens in common lie on bits in common; of several tokens on one bit all but one are spare.
    """
    return (UP + LOW) * (common_bits + spare) >= LOW * total


def likely(pairs: DataFrame, sizes: DataFrame, sigs: DataFrame) -> DataFrame:
    """(hub, node) pairs whose sizes and signatures allow a link; no text is moved for the others."""
    hubs = sizes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    sized = pairs.join(hubs, "hub").join(sizes.select("node", "n"), "node")
    sized = sized.where((UP * F.col("n") >= LOW * F.col("hub_n")) & (UP * F.col("hub_n") >= LOW * F.col("n")))
    named = sized.join(sigs.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub").join(sigs, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, node, hub_n, n, hub_sig, sig = batch.columns
            ok = np.zeros(batch.num_rows, bool)
            sizes = zip(hub_n.to_pylist(), n.to_pylist(), hub_sig.to_pylist(), sig.to_pylist())
            for i, (a, b, x, y) in enumerate(sizes):
                maps = bitmaps([x, y], min(len(x), len(y)) // 8)
                bits = np.bitwise_count(maps).sum(1)
                both = int(np.bitwise_count(maps[0] & maps[1]).sum())
                ok[i] = enough(both, min(a - int(bits[0]), b - int(bits[1])), a + b)
            yield pa.RecordBatch.from_arrays([hub.filter(pa.array(ok)), node.filter(pa.array(ok))], names=["hub", "node"])

    out = named.select("hub", "node", "hub_n", "n", "hub_sig", "sig").mapInArrow(run, "hub long, node long")
    return keep(out, "likely")


def wanted_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (with node) and the node's ``text``. Only texts that are wanted leave their place, each scan picks them out."""
    texts = docs.select(F.col("__row").alias("node"), F.col("__text").alias("text"))
    return wanted.join(picked(texts, "node", wanted.select("node").distinct(), "left_semi"), "node")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of (hub, node) pairs, by exact comparison of their sets, as (a, b).

    Every hub's text comes once per STAR partners, and one pass over rows sorted by hub holds one hub's set at a
    time, so a hub of any number of partners is compared in many tasks.
    """
    sizes = pairs.groupBy("hub").agg((F.floor(F.count("*") / STAR) + 1).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    hubs = sizes.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    meet = wanted_texts(dealt.unionByName(hubs), docs)
    meet = meet.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column(2).to_pylist())
                for h, n, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets):
                    if h == n:
                        hub, own = h, s
                    elif h != hub:
                        raise ValueError("rows of the input moved between two readings")
                    elif linked(overlap(own, s), len(own), len(s)):
                        a.append(h)
                        b.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return keep(meet.select("hub", "node", "text").mapInArrow(run, "a long, b long"), "links")


class Tree:
    """Signature tree over rows: leaves of FANOUT rows, inner nodes with OR-ed bitmaps and ranges of sizes.

    ``spare`` is the largest number of tokens of one set that share their bit with another of its tokens.
    """

    def __init__(self, n: np.ndarray, maps: np.ndarray, comp: np.ndarray):
        self.levels = [(n, n, maps, n - np.bitwise_count(maps).sum(1), comp, comp)]
        while len(self.levels[-1][0]) > 1:
            low, high, bits, spare, first, last = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(bits, cut),
                np.maximum.reduceat(spare, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut),
            ))

    def may_link(self, level: int, x: np.ndarray, other: Tree, y: np.ndarray) -> np.ndarray:
        """Whether pairs of nodes of one level can hold a linked pair of different components."""
        a, b = self.levels[level], other.levels[level]
        sizes = (UP * a[1][x] >= LOW * b[0][y]) & (UP * b[1][y] >= LOW * a[0][x])
        new = ~((a[4][x] == a[5][x]) & (b[4][y] == b[5][y]) & (a[4][x] == b[4][y]))
        ok = np.flatnonzero(sizes & new)
        both = np.bitwise_count(a[2][x[ok]] & b[2][y[ok]]).sum(1)
        may = np.zeros(len(x), bool)
        may[ok] = enough(both, np.minimum(a[3][x[ok]], b[3][y[ok]]), a[0][x[ok]] + b[0][y[ok]])
        return may


def traverse(left: Tree, right: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from the roots: only pairs of nodes whose largest possible overlap suffices are opened."""
    level = min(len(left.levels), len(right.levels)) - 1
    xs, ys = (t.ravel() for t in np.meshgrid(np.arange(len(left.levels[level][0])), np.arange(len(right.levels[level][0])), indexing="ij"))
    while True:
        if left is right:
            half = xs <= ys
            xs, ys = xs[half], ys[half]
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(xs), 65536):
            x, y = xs[i : i + 65536], ys[i : i + 65536]
            ok = left.may_link(level, x, right, y)
            found[0].append(x[ok])
            found[1].append(y[ok])
        xs, ys = np.concatenate(found[0]), np.concatenate(found[1])
        if level == 0:
            different = xs != ys if left is right else np.ones(len(xs), bool)
            return xs[different], ys[different]
        level -= 1
        child = np.arange(FANOUT)
        many_x, many_y = len(left.levels[level][0]), len(right.levels[level][0])
        xs, ys = (
            np.repeat(xs[:, None] * FANOUT + child, FANOUT, axis=1).ravel(),
            np.tile(ys[:, None] * FANOUT + child, (1, FANOUT)).ravel(),
        )
        inside = (xs < many_x) & (ys < many_y)
        xs, ys = xs[inside], ys[inside]


def bitmaps(sigs: list[bytes], width: int) -> np.ndarray:
    """Signatures folded to one width in 64-bit words; a fold keeps every token's lowest hash bits."""
    out = np.zeros((len(sigs), width), np.uint64)
    for i, s in enumerate(sigs):
        words = np.frombuffer(s, "<u8")
        out[i] = np.bitwise_or.reduce(words.reshape(-1, width), axis=0) if len(words) >= width else 0
    return out


def partnered(members: DataFrame) -> DataFrame:
    """(grp, node, comp, n, size) of the members that some other member of their group may match by size.

    Classes of sizes are powers of 4/3, so sizes that allow a link lie in one class or in neighbouring ones.
    """
    sized = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(UP / LOW))).cast("int"))
    held = sized.groupBy("grp", "size").agg(F.count("*").alias("k"))
    near = held.select("grp", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "k")
    some = near.groupBy("grp", "size").agg(F.sum("k").alias("k")).where("k > 1").select("grp", "size")
    return sized.join(some, ["grp", "size"], "left_semi")


def tree_pairs(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Candidate pairs of different components within each group of (grp, node, comp, n), one row per meeting.

    Returns meet (a number), x, y (arrays: the pairs' nodes) and cx, cy (their components).
    A group of any size is cut by classes of sizes into blocks of about BLOCK rows; blocks meet block by block when
    their ranges of sizes and components allow a new link, and each meeting is a dual traversal of two signature
    trees. Rows of one component lie side by side in a tree, which keeps bitmaps sparse. Signatures join last.
    """
    sized = keep(partnered(members), "members")
    parts = sized.groupBy("grp", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = F.col("size").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("node"), F.col("parts"))
    blocked = keep(sized.join(parts, ["grp", "size"]).withColumn("block", block).drop("size", "parts"), "blocks")
    ends = blocked.groupBy("grp", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("k")
    )
    other = ends.select(*[F.col(c).alias("o_" + c) for c in ends.columns])
    alone = (F.col("block") == F.col("o_block")) & (F.col("k") == 1)
    meets = ends.join(other, (F.col("grp") == F.col("o_grp")) & (F.col("block") <= F.col("o_block"))).where(
        ~alone & (F.col("high") * UP >= F.col("o_low") * LOW) & ((F.col("c1") != F.col("o_c2")) | (F.col("c2") != F.col("o_c1")))
    )
    meets = meets.select("grp", F.col("block").alias("i"), F.col("o_block").alias("j"))
    sides = meets.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = sides.join(blocked, ["grp", "block"]).join(sigs, "node")
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block", "comp", "n", "node")

    def meet(part: pa.Table, i: int, j: int) -> list[np.ndarray]:
        sigs = part.column("sig").to_pylist()
        maps = bitmaps(sigs, min(map(len, sigs)) // 8)
        n, comp, node, block = (part.column(c).to_numpy() for c in ("n", "comp", "node", "block"))
        a, b = block == i, block == j
        left = Tree(n[a], maps[a], comp[a])
        right = left if i == j else Tree(n[b], maps[b], comp[b])
        x, y = traverse(left, right)
        return [node[a][x], node[b][y], comp[a][x], comp[b][y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:  # a meeting has about 2 * BLOCK rows and may go over a batch's end
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cuts = starts(table)
            rest = table.slice(cuts[-1])
            yield from done(table, cuts)
        if rest is not None:
            yield from done(rest, [0, rest.num_rows])

    def starts(table: pa.Table) -> list[int]:
        keys = np.stack([table.column(c).to_numpy() for c in ("grp", "i", "j")])
        return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]

    def done(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a)
            out.append(meet(part, part.column("i")[0].as_py(), part.column("j")[0].as_py()))
        out = [found for found in out if len(found[0])]
        columns = [pa.array([found[k] for found in out], pa.list_(pa.int64())) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "cx", "cy"])

    found = rows.select("grp", "i", "j", "block", "node", "comp", "n", "sig").mapInArrow(
        run, "x array<long>, y array<long>, cx array<long>, cy array<long>"
    )
    return keep(found.withColumn("meet", F.monotonically_increasing_id()), "candidates")


def verify_meetings(meetings: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among the candidates of each meeting that join its components, by exact comparison, as (a, b).

    A meeting's texts come to it once each, however many pairs they are in. A pair is compared only if what the
    meeting has linked so far does not join it already, so a group of near copies costs about one comparison per text.
    """
    nodes = meetings.select("meet", F.explode(F.array_distinct(F.concat("x", "y"))).alias("node"))
    none = F.lit(None).cast("array<long>")
    texts = wanted_texts(nodes, docs).select("meet", "node", "text", *[none.alias(c) for c in ("x", "y", "cx", "cy")])
    heads = meetings.select("meet", F.lit(None).cast("long").alias("node"), F.lit(None).cast("string").alias("text"), "x", "y", "cx", "cy")
    rows = heads.unionByName(texts).repartition("meet").sortWithinPartitions("meet", F.col("node").isNotNull(), "node")

    def compare(head: tuple, sets: dict[int, np.ndarray]) -> tuple[list, list]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        a, b = [], []
        for x, y, cx, cy in zip(*head):
            cx, cy = find(cx), find(cy)
            if cx != cy and linked(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                root[max(cx, cy)] = min(cx, cy)
                a.append(x)
                b.append(y)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, {}
        for batch in batches:
            a, b = [], []
            numbers, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = shingle_sets(texts)
            for i, n in enumerate(numbers):
                if n is None:
                    if head:
                        for out, more in zip((a, b), compare(head, sets)):
                            out += more
                    head, sets = [batch.column(k)[i].as_py() for k in range(3, 7)], {}
                else:
                    sets[n] = made[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if head:
            a, b = compare(head, sets)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return keep(rows.select("meet", "node", "text", "x", "y", "cx", "cy").mapInArrow(run, "a long, b long"), "links")


def _linked_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Described rows, nodes (set, node, least key, n) and components of the nodes that are linked."""
    common = common_shingles(docs, docs.count(), "__text")
    rows = describe(docs, common, "__text")
    full = rows.where("n > 0")
    first = F.min(F.when(F.col("rare").isNotNull(), F.col("__row")))
    nodes = keep(full.groupBy("set").agg(first.alias("node"), F.min("__key").alias("least"), F.first("n").alias("n")), "nodes")
    first = firsts(full, nodes)
    tokens = shared_tokens(first)
    sigs = first.select("node", "sig")

    # every node with the first node of each of its tokens
    pairs = tokens.select(F.col("low").alias("hub"), "node").where("hub <> node").distinct()
    links = verify(likely(pairs, nodes, sigs), docs)
    groups = keep(components(links), "components")

    # nodes still apart, with the last node; a token with two nodes has been compared
    left = keep(across(tokens.where("k > 2"), groups), "apart")
    pairs = differing(left.select(F.col("high").alias("hub"), "node").where("hub <> node").distinct(), groups)
    links = links.unionByName(verify(likely(pairs, nodes, sigs), docs))
    groups = keep(components(links), "components")

    # nodes still apart, with each other; the first node has met all of its group
    members = left.select(F.col("low").alias("grp"), "node").where("grp <> node").distinct().join(nodes.select("node", "n"), "node")
    members = with_component(members, groups).select("grp", "node", "comp", "n")
    found = verify_meetings(tree_pairs(members, sigs), docs)
    groups = components(links.unionByName(found))
    return rows, nodes, groups


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", reread: bool = False) -> DataFrame:
    """Per row: ``key``, n_shingles (size of its set) and component_id, the smallest key reachable by links.

    Two texts are linked when the Jaccard similarity of their sets is 3/4 or more; the result is that of comparing all
    pairs. Steps: (1) rows with one set become one node; (2) prefix tokens (rare shingles first) meet, only nodes that
    share one can be linked; (3) every node is compared with the first, then with the last node of each of its
    tokens where their sizes and signatures allow a link, which joins a family of copies without listing its pairs;
    (4) nodes that share a token but are still in different components meet in signature trees, and what the trees'
    bounds leave is compared exactly.

    Null and empty texts have n_shingles 0 and are their own component; a null key is carried (component_id is the
    smallest key that is not null, else null); rows with one key are compared each by itself; repeated rows fall
    together; an empty table gives no rows; other columns are not carried. ``reread`` says that ``docs`` is a table of
    Parquet files, whose rows are numbered by their place there; otherwise it is written once first.
    """
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    docs = with_row(docs, reread)
    with small_batches(docs.sparkSession):  # every step that runs Python is written before this ends
        rows, nodes, groups = _linked_nodes(docs)

    placed = nodes.join(groups, "node", "left").select("set", "least", F.coalesce("component", "node").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = placed.join(ids, "component").select("set", "component_id")
    named = rows.where("n > 0").select("__key", "n", "set").join(by_set, "set").select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.col("__key").alias("component_id"))
    return named.unionByName(alone)


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group of ``jaccard_groups``: the one with the smallest key.

    Rows are told apart by their place in ``docs``, a table of Parquet files, so exactly one row of a group stays even where
    keys repeat or are null: nulls come last, the first place decides among equal keys. Null and empty texts are their
    own group each. All columns are carried.
    """
    docs = with_row(docs, True)
    with small_batches(docs.sparkSession):
        rows, nodes, groups = _linked_nodes(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), "__row"))
    order = F.min(F.struct(F.col("__key").isNull().alias("none"), "__key", "__row")).alias("lead")
    leads = rows.where("n > 0").groupBy("set").agg(order)
    placed = nodes.join(groups, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    best = placed.join(leads, "set").groupBy("component").agg(F.min("lead").alias("lead")).select("lead.__row")
    kept = keep(best.unionByName(rows.where("n = 0").select("__row")), "firsts")
    return picked(docs, "__row", kept, "left_semi").drop("__row")


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``comp``, the node's component. Components are a broadcast if they are FEW, counted, else a shuffle of both."""
    few = groups.count() <= FEW
    return rows.join(F.broadcast(groups) if few else groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def across(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, node, low, high) of the tokens whose nodes are in different components."""
    known = with_component(tokens.select("token", "node", "low", "high"), groups)
    mixed = known.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where(F.col("c1") != F.col("c2"))
    return known.drop("comp").join(mixed.select("token"), "token", "left_semi")


def differing(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components."""
    ends = with_component(pairs, groups).select("hub", F.col("node").alias("other"), F.col("comp").alias("c1"))
    ends = with_component(ends.withColumnRenamed("hub", "node"), groups).where(F.col("c1") != F.col("comp"))
    return ends.select(F.col("node").alias("hub"), F.col("other").alias("node"))
