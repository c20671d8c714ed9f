import os
from collections import Counter

import pytest

import corpus_pipeline
from seqspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs.toPandas(), result.toPandas()))
        docs = result
    return out


def test_columns_and_order(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packed"]
    for _, after in stages[:-1]:
        assert list(after.columns) == corpus_pipeline.COLUMNS


def test_quality_drops_what_fails_and_changes_nothing(stages):
    from test_rules_and_lines import measured

    before, after = stages[0]
    kept = before.set_index("doc_id").loc[after["doc_id"]]
    assert (kept["text"].values == after["text"].values).all()
    for text in before[~before["doc_id"].isin(after["doc_id"])]["text"]:
        n, chars, symbols, dup, repeats = measured(text)
        assert n < 50 or 2 * repeats > n or symbols > 0.1 * n or not 2.5 <= chars / n <= 12 or dup > 0


def test_lines_stage_is_brute_force(stages):
    from test_rules_and_lines import brute_lines

    before, after = stages[1]
    rows = [(int(r.doc_id), r.text, r.lang, r.source) for r in before.itertuples()]
    want = Counter((k, t) for k, t, _, _ in brute_lines(rows, 5, True))
    assert Counter((int(r.doc_id), r.text) for r in after.itertuples()) == want
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_one_of_each_group_stays(stages):
    from test_similarity import brute

    before, after = stages[2]
    groups = brute([(int(r.doc_id), r.text) for r in before.itertuples()])
    assert sorted(after["doc_id"]) == sorted({g for _, _, g in groups})


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_null(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a)] * 5 + [(1, b), (3, b), (None, c), (None, c), (None, d), (2, d), (None, a), (None, ""), (None, "")]
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame([(k, t, "en", f"row {n}", 0) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(path)
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, a), (1, b), (None, c), (2, d), (None, ""), (None, "")])
    assert all(rows[int(r.source.split()[1])] == (r.doc_id, r.text) for r in got)


def test_mix_and_packing(stages):
    before, after = stages[3]
    size = {r.doc_id: len(r.text.split()) for r in before.itertuples()}
    assert abs(after["text"].str.split().str.len().sum() - 1.5 * sum(size.values())) <= 0.02 * sum(size.values()) + len(set(before["source"]))
    taken = Counter()
    for r in after.itertuples():
        taken[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * size[k] for k, n in taken.items())
    texts = dict(zip(before["doc_id"], before["text"]))
    assert all(texts[r.doc_id].lstrip().startswith(r.text.strip()) for r in after.itertuples())
    before, packed = stages[4]
    assert set(packed["doc_id"]) == set(before["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def written(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_takes_an_empty_table(spark, tmp_path, name, stage):
    out = stage(spark, written(spark, [], str(tmp_path / "none")), SF)
    assert out.collect() == []
    assert name == "packed" or out.columns == corpus_pipeline.COLUMNS


def odd_rows():
    a, b = ("the of " + " ".join(f"{x}{i}" for i in range(58)) for x in "ab")
    return [(1, a, "en", "x", 0), (1, a, "en", "x", 0), (1, b, None, None, None), (None, b, "en", None, 0), (2, None, "en", "x", 0),
            (3, "", "en", None, 0), (4, " \n ", "en", "y", 0), (5, "w " * 30_000, "en", "y", 0)]


def test_quality_and_lines_take_nulls_and_repeats(spark, tmp_path):
    rows = odd_rows()
    docs = written(spark, rows, str(tmp_path / "docs"))
    kept = corpus_pipeline.quality(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((k, t) for k, t, *_ in rows[:4])
    lines = corpus_pipeline.lines(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in lines) == Counter((k, t) for k, t, *_ in rows)


def test_mixture_takes_nulls_and_repeats(spark, tmp_path):
    rows = odd_rows()
    out = corpus_pipeline.mixture(spark, written(spark, rows, str(tmp_path / "docs")), SF).collect()
    size = {s: sum(len((t or "").split()) for _, t, _, x, _ in rows if x == s) for s in ("x", "y", None)}
    taken = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in size}
    # 45,360 words by 5:2:1; x and the null source (the last) stop at twice their words, y takes the rest
    assert size == {"x": 120, "y": 30_000, None: 120}
    assert taken == {"x": 240, None: 240, "y": 45_360 - 480}
    assert {r.doc_id for r in out} == {1, None, 5}


def test_packed_holds_nulls_repeats_and_copies(spark, tmp_path):
    from seqspark.llm.packing import END_ID, cut_points, token_ids
    from seqspark.llm.queries import tokenizer

    rows = odd_rows()
    out = corpus_pipeline.packed(spark, written(spark, rows, str(tmp_path / "docs")), SF).collect()
    lengths = [(k, len(token_ids(t or "", tokenizer()))) for k, t, *_ in rows]
    want = Counter((k, p, *cut) for k, n in lengths for p, cut in enumerate(cut_points(n, 1024)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    assert len({r.doc_row for r in out}) == len(rows) and END_ID == 2
    place = sorted((r.sequence_id, r.offset, r.length) for r in out)
    for before, after in zip(place, place[1:]):
        assert after[1] == (before[1] + before[2] if before[0] == after[0] else 0)


def test_run_is_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1][1])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)  # an anchor has many rows
    a, b = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)
