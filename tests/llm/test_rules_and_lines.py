import re
from collections import Counter

import pytest

from seqspark.llm.boilerplate import dedup_lines
from seqspark.llm.quality import STOP_WORDS, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "  \n", "a b c a b c", "x x x x x", "a\nb\na\n\n", "# $ & | <b> % *", "w " * 60, "é ü b", "a b c d " * 5000]


def test_measures(spark, docs, corpus):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == {i: measured(t) for i, t in rows}
    got = Counter(tuple(r[n] for n in names) for r in quality_rules(docs).collect())
    assert got == Counter(measured(r[1]) for r in corpus)


def test_verdicts(spark):
    stop = STOP_WORDS["en"].split()
    clean = " ".join(f"{a} {b}thing" for a in stop for b in stop[:6])
    cases = {
        "clean": (clean, []),
        "short": ("the of and", ["few_words"]),
        "symbols": (clean.replace("thing", "## $"), ["symbols"]),
        "repeats": ("the of and to " * 40, ["repeated_words"]),
        "foreign": (" ".join(f"qz{i}" for i in range(80)), ["stop_words"]),
        "lines": ("\n".join([clean] + ["the end of it"] * 40), ["duplicate_lines"]),
        "none": (None, ["few_words", "word_length", "stop_words"]),
    }
    got = quality_rules(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string"))
    for r in got.collect():
        want = cases[r["doc_id"]][1]
        assert set(want) <= set(r["failed"]) and (r["kept"] == (not want)), r["doc_id"]
        assert r["base_failed"] == bool({"few_words", "repeated_words"} & set(r["failed"]))


def test_rules_are_one_projection(spark, docs):
    plan = quality_rules(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "HashAggregate" not in plan


def brute_lines(rows, least, first):
    sites, seen = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for k, x in enumerate((rows[i][1] or "").split("\n")):
            if WORD.search(x):
                sites.setdefault(x, set()).update([rows[i][3]] if rows[i][3] is not None else [])
                seen.setdefault(x, (i, k))
    wide = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, r in enumerate(rows):
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        gone = {k for k, x in enumerate(lines) if x in wide and not (first and seen[x] == (i, k))}
        out.append((r[0], "\n".join(x for k, x in enumerate(lines) if k not in gone), sum(bool(WORD.search(x)) for x in lines), len(gone)))
    return Counter(out)


@pytest.mark.parametrize("least,first", [(5, True), (5, False), (2, True), (50, True)])
def test_lines_like_brute_force(spark, corpus, least, first):
    rows = list(dict.fromkeys(corpus))  # equal rows tie for the first place of a line
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(df, least, first).collect())
    assert got == brute_lines(rows, least, first)


def test_all_documents_stay(docs, corpus):
    got = dedup_lines(docs)
    assert got.count() == len(corpus) and "size" in got.columns


def test_no_rows(no_docs):
    assert dedup_lines(no_docs).collect() == [] and quality_rules(no_docs).collect() == []


def test_many_sites_are_sketched_and_near_ones_counted(spark):
    rows = [(i, f"wide line {k}" if i < n else f"own {i} {k}", f"s{i}") for k, n in enumerate((39, 40, 41, 300)) for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = Counter(r["text"] == "" for r in dedup_lines(df, 40, False).collect())
    assert gone[True] == 40 + 41 + 300
