"""Quality scores of whole documents by gated attention over their passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replace_columns

PASSAGE = 64  # words of a passage
SLAB = 1 << 20  # bytes of text that are encoded at a time
FIT_DOCS = 4096  # labelled rows that a fit reads at most
FIT_BYTES = 1 << 16  # longest text that a fit reads; longer ones are scored like all others
FIT_PASSAGES = 1 << 15  # passages that a fit reads at most
BUCKETS = 192  # of hashed words
HIDDEN, GATE = 24, 12

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_classes() -> np.ndarray:
    """One class per lower-case letter and ASCII mark, one each for capitals, digits, spaces, line ends, lead and inner bytes."""
    kinds = np.zeros(256, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for k, b in enumerate(marks):
        kinds[b] = k + 1
    n = len(marks) + 1
    for k in range(26):
        kinds[97 + k] = n + k
    n += 26
    kinds[65:91], kinds[48:58], kinds[_SPACE], kinds[10] = n, n + 1, n + 2, n + 3
    kinds[128:192], kinds[192:224], kinds[224:256] = n + 4, n + 5, n + 6
    return kinds


KINDS = _byte_classes()
N_KINDS = int(KINDS.max()) + 1
WIDTH = N_KINDS + BUCKETS + 9


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(n, _STEP, np.uint64)
    back = np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts in ``data`` (UTF-8 bytes; text i begins at starts[i], the next text ends it).

    Returns (features, text of each passage). A passage is 64 words of one text, the last one fewer; a text without
    words has one passage, an empty text's is all zeros. What else is in ``data`` makes no difference.
    """
    n_texts, size = len(starts), len(data)
    space = _SPACE[data]
    first = np.ones(size + 1, bool)
    first[1:size] = space[:-1]
    first[starts[starts < size]] = True
    word_at = np.flatnonzero(first[:size] & ~space)
    last = np.ones(size, bool)
    last[:-1] = space[1:]
    inner = starts[(starts > 0) & (starts < size)]
    last[inner - 1] = True
    word_end = np.flatnonzero(last & ~space) + 1
    text_of = np.searchsorted(starts, word_at, side="right") - 1
    per_text = np.bincount(text_of, minlength=n_texts)
    before = np.cumsum(per_text) - per_text
    place = np.arange(len(word_at)) - before[text_of]
    per_text_passages = np.maximum(1, -(-per_text // PASSAGE))
    base = np.cumsum(per_text_passages) - per_text_passages
    n = int(per_text_passages.sum())
    owner = np.repeat(np.arange(n_texts), per_text_passages)
    out = np.zeros((n, WIDTH), np.float32)
    if not size:
        return out, owner
    passage = base[text_of] + place // PASSAGE
    n_words = np.bincount(passage, minlength=n).astype(np.float32)
    some = np.maximum(n_words, 1)

    # bytes belong to the passage of the last word of their text that begins at or before them, else to its first one
    of_byte = np.repeat(base, np.diff(np.append(starts, size)))
    begun = np.concatenate([[0], passage])[np.cumsum(first[:size] & ~space)]
    of_byte = np.maximum(of_byte, begun)
    counts = np.bincount(of_byte * N_KINDS + KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    n_bytes = np.maximum(counts.sum(1), 1)
    out[:, :N_KINDS] = np.sqrt(counts / n_bytes[:, None])

    if not len(word_at):
        return out, owner
    up, down = _powers(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    code = (sums[word_end] - sums[word_at]) * down[word_at]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    bucket = (code % np.uint64(BUCKETS)).astype(np.int64)
    hashed = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, N_KINDS : N_KINDS + BUCKETS] = np.sqrt(hashed / some[:, None])

    def share(of: np.ndarray) -> np.ndarray:
        return np.bincount(passage, of, minlength=n).astype(np.float32) / some

    length = (word_end - word_at).astype(np.float64)
    again = np.zeros(len(code))
    again[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((code, passage))
    repeated = np.zeros(len(code))
    repeated[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    head, tail = data[word_at], data[word_end - 1]
    mean = share(length)
    out[:, -9:] = np.stack(
        [
            mean / 8, np.sqrt(np.maximum(share(length**2) - mean**2, 0)) / 8, share(again), share(repeated), share((head >= 65) & (head <= 90)),
            share((tail < 128) & (KINDS[tail] <= 32) & (KINDS[tail] > 0)), share(length == 1), np.log1p(n_words) / 4, (n_words > 0),
        ],
        axis=1,
    )
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class GatedAttention:
    """Encoder, gate and output weights; ``prior`` answers where there was nothing to learn from."""

    weights: dict[str, np.ndarray]
    prior: float = 0.5

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages and their attention energies, in double precision: what is in a batch shows only beyond 12 digits."""
        w = self.weights
        h = np.tanh(((x.astype(np.float64) - w["mean"]) * w["scale"]) @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]

    def answer(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ self.weights["c"] + self.weights["c0"])


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 24, batch: int = 64, rate: float = 0.01, seed: int = 7) -> GatedAttention:
    """Fit by Adam on document labels only; ``owner`` (ascending) says which document a passage belongs to."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(y) == 0 or y.min() == y.max():
        return GatedAttention({}, prior)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    x = ((x - mean) * scale).astype(np.float32)
    w = {
        "W": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b": np.zeros(HIDDEN), "V": rng.standard_normal((HIDDEN, GATE)) / 5,
        "U": rng.standard_normal((HIDDEN, GATE)) / 5, "a": rng.standard_normal(GATE) / 5, "c": rng.standard_normal(HIDDEN) / 5, "c0": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    ends = np.searchsorted(owner, np.arange(len(y) + 1))
    step = 0
    for turn in range(rounds):
        for docs in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
            rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in docs])
            sizes = ends[docs + 1] - ends[docs]
            at = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(docs)), sizes)
            xb, yb = x[rows], y[docs].astype(np.float32)
            h = np.tanh(xb @ w["W"] + w["b"])
            t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
            e = (t * g) @ w["a"]
            e = np.exp(e - np.maximum.reduceat(e, at)[own])
            alpha = e / np.add.reduceat(e, at)[own]
            z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
            d_logit = (_sigmoid(z @ w["c"] + w["c0"]) - yb) / len(docs)
            dz = d_logit[:, None] * w["c"]
            d_alpha = (dz[own] * h).sum(1)
            d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, at)[own])
            d_tg = d_e[:, None] * w["a"]
            d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
            dh = alpha[:, None] * dz[own] + d_t @ w["V"].T + d_g @ w["U"].T
            d_pre = dh * (1 - h * h)
            grads = {
                "W": xb.T @ d_pre + 1e-4 * w["W"], "b": d_pre.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "a": (t * g).T @ d_e,
                "c": z.T @ d_logit + 1e-4 * w["c"], "c0": d_logit.sum(keepdims=True),
            }
            step += 1
            now = rate * (1 - turn / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                w[k] = (w[k] - now * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    w = w | {"mean": mean, "scale": scale}
    return GatedAttention({k: v.astype(np.float64) for k, v in w.items()}, prior)


def _slabs(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut one text into pieces of at most a slab, at white space where there is some."""
    at = 0
    while len(data) - at > SLAB:
        spaces = np.flatnonzero(_SPACE[data[at : at + SLAB]])
        end = at + (int(spaces[-1]) + 1 if len(spaces) else SLAB)
        yield at, end
        at = end
    yield at, len(data)


def score_texts(model: GatedAttention, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of passages of each text of a binary array (null: empty), one slab of bytes in memory at a time.

    The softmax over passages is summed slab by slab with a running maximum, so a text of any length is read whole.
    """
    texts = texts.fill_null(b"")
    n = len(texts)
    passages = np.zeros(n, np.int64)
    if not model.weights:
        return np.full(n, model.prior), passages
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))

    def add(rows: np.ndarray, bytes_: np.ndarray, starts: np.ndarray) -> None:
        x, owner = encode(bytes_, starts)
        h, e = model.passages(x)
        at = np.searchsorted(owner, np.arange(len(rows)))
        high = np.maximum(top[rows], np.maximum.reduceat(e, at))
        w = np.exp(e - high[owner])
        keep = np.exp(top[rows] - high)
        total[rows] = total[rows] * keep + np.add.reduceat(w, at)
        z[rows] = z[rows] * keep[:, None] + np.add.reduceat(w[:, None] * h, at, axis=0)
        top[rows] = high
        passages[rows] += np.bincount(owner, minlength=len(rows))

    i = 0
    while i < n:
        if offsets[i + 1] - offsets[i] > SLAB:
            own = data[offsets[i] : offsets[i + 1]]
            for a, b in _slabs(own):
                add(np.array([i]), own[a:b], np.array([0]))
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1
        j = min(max(j, i + 1), n)
        add(np.arange(i, j), data[offsets[i] : offsets[j]], (offsets[i:j] - offsets[i]).astype(np.int64))
        i = j
    return np.round(model.answer(z / total[:, None]), 9), passages


def held_out(key: Column) -> Column:
    """True for a fifth of the keys, by the checksum of their text; false where the key is null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> GatedAttention:
    """Fit on a bounded sample of labelled rows that are not held out.

    At most FIT_DOCS keys (those with the smallest hashes), of these the texts up to FIT_BYTES bytes and together up
    to FIT_PASSAGES passages; null keys and null labels are not read, null texts count as empty. A key that repeats
    in ``labels`` has its largest label; repeated rows of ``docs`` count up to the same bounds.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    known = known.where(F.col("__key").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__key")))
    known = known.groupBy("__key").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(FIT_DOCS)
    own = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).where(F.octet_length("__text") <= FIT_BYTES)
    # FIT_DOCS rows of a key and a label: small however large the tables are
    own = own.join(F.broadcast(known), "__key").orderBy(F.xxhash64("__key"), F.xxhash64("__text"), "__text").limit(FIT_DOCS)
    rows = own.select("__label", F.col("__text").cast("binary").alias("__text")).toArrow()
    x, owner, y, used = [], [], [], 0
    for one, given in zip(rows["__text"], rows["__label"]):
        data = np.frombuffer(one.as_py(), np.uint8)
        features, _ = encode(data, np.array([0]))
        if used + len(features) <= FIT_PASSAGES:
            x.append(features)
            owner.append(np.full(len(features), len(y)))
            y.append(given.as_py())
            used += len(features)
    if not y:
        return GatedAttention({}, 0.5)
    return fit(np.concatenate(x), np.concatenate(owner), np.array(y))


def score_quality(docs: DataFrame, model: GatedAttention, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1, higher: better), predicted (1 from the threshold on) and n_passages to every row.

    Every passage of the whole text is encoded and takes part with its attention weight. Null and empty texts have one
    empty passage; repeated rows have equal scores (rounded to 9 digits); input columns named like the new ones are replaced; an empty table
    gives no rows. A model without labels answers 0.5, one with a single label a smoothed share of it.
    """
    new = ["score", "predicted", "n_passages"]
    base = replace_columns(docs, new)
    names, where = [*base.columns, *new], base.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, n = score_texts(shared.value, b.column(where).cast(pa.large_binary()))
            columns = [*b.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, ", ".join([*fields, "score double, predicted int, n_passages long"]))
