import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghiklmnoprstuz") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """Documents with copies, near copies, shared lines, nulls, empties, one very long text and clashing columns."""
    rng = random.Random(9)

    def text(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n // 12 + 1))

    base = [text(rng.randint(20, 300)) for _ in range(60)]
    rows = list(base)
    for i in range(0, 40, 4):
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        rows += [base[i], " ".join(w), base[i].upper()]
    shared = "one line that stands on very many sites of the net"
    rows = [r + "\n" + shared if k % 3 == 0 else r for k, r in enumerate(rows)]
    rows += ["", None, " \n\t ", "one two", "One TWO", "a b c d e", text(30_000), "x" * 50_000, "é ü " * 300]
    data = [(i, t, "en", None if i % 11 == 0 else f"s{i % 7}", 0) for i, t in enumerate(rows)]
    data += [(None, base[0], "en", "s1", 0), (3, base[5], None, None, None), (3, base[5], None, None, None)]
    return data


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    for c in ("size", "shard", "slot", "spans", "taken", "words", "n_words", "kept", "offset", "n_lines", "Text_md5"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
