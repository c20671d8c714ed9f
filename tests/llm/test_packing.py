import random
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from seqspark.llm.packing import cut_points, pack_documents, piece_digest, plan_bins, runs, sequences, token_ids  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_length_and_waste_little(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1024, rng.randint(1, 1024), rng.randint(200, 700), rng.randint(1, 60)]) for _ in range(3000)]
    bins = plan_bins(Counter(lengths))
    got = Counter()
    for b in bins:
        assert sum(n * c for n, c in b.content) + b.room == 1024 and b.room >= 0 and b.count > 0
        for n, c in b.content:
            got[n] += c * b.count
    assert got == Counter(lengths)
    assert sum(b.count for b in bins) <= 1.02 * ceil(sum(lengths) / 1024) + 1
    ends = defaultdict(int)
    for r in runs(bins):
        assert r["__low"] == ends[r["length"]]
        ends[r["length"]] = r["__high"]
    assert ends == got


def test_small_plans():
    assert plan_bins({}) == []
    assert sum(b.count for b in plan_bins({512: 2, 1: 1})) == 2
    assert sum(b.count for b in plan_bins({1: 1025})) == 2
    assert sum(b.count for b in plan_bins({700: 3, 324: 3})) == 3


def test_cuts():
    assert cut_points(1, 4) == [(0, 1)] and cut_points(4, 4) == [(0, 4)] and cut_points(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_documents_come_back_whole(docs, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    got = pack_documents(docs, PATH, 256).collect()
    want = Counter()
    for r in corpus:
        ids = np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, n) in enumerate(cut_points(len(ids), 256)):
            want[(r[0], k, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    place = defaultdict(list)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in place.values():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 256
    assert len(place) <= 1.05 * sum(r["length"] for r in got) / 256 + 2


def test_sequences_hold_the_ids_in_order(spark):
    df = spark.createDataFrame([(i, "some words " * (i + 1)) for i in range(30)], "doc_id long, text string")
    packed = pack_documents(df, PATH, 64)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    for t in ["", "Hello, wörld!  \n\n x", "<|endoftext|> in text", "a" * 3000, "日本語   ñandú\t\r\n", "it's 12,345.67"]:
        assert token_ids(t, PATH).tolist() == plain.encode(t, add_special_tokens=False).ids + [2]


def test_encoders_agree_on_random_texts():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(PATH), random.Random(3)
    ranges = [(32, 126), (9, 13), (160, 591), (880, 1279), (1424, 1791), (2304, 2431), (3584, 3711), (12352, 12543),
              (19968, 40959), (0x1F300, 0x1F64F), (0x2000, 0x206F)]
    for _ in range(20_000):
        some = rng.sample(ranges, 3)
        t = "".join(chr(rng.randint(*rng.choice(some))) for _ in range(rng.randint(0, 40)))
        assert token_ids(t, PATH).tolist() == plain.encode(t, add_special_tokens=False).ids + [2], t


def test_digest_is_read_from_the_sequences(spark, docs, monkeypatch):
    import seqspark.llm.packing as packing

    monkeypatch.setattr(packing, "HELD_IDS", 500)
    packed = packing.pack_pieces(packing.pieces(docs, PATH, 256, with_ids=True), 256)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_row", "sequence_id", "offset"]
    got = piece_digest(sequences(packed, with_parts=True))
    assert got.columns == names
    want = packed.select(*names).collect()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want))
    assert len({(r["doc_row"], r["piece"]) for r in want}) == len(want)
    # a sequence that holds other ids gives another digest
    from pyspark.sql import functions as F

    broken = sequences(packed, with_parts=True).withColumn("ids", F.reverse("ids"))
    assert Counter(map(tuple, piece_digest(broken).collect())) != Counter(map(tuple, want))


def test_no_rows(no_docs):
    assert pack_documents(no_docs, PATH).collect() == []
    assert piece_digest(sequences(pack_documents(no_docs, PATH), with_parts=True)).collect() == []
