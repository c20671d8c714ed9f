"""Every policy and mode against the definitions, and the published small-stream counts."""

import os

import brute
import pytest
from helpers import WORKED, frame, id_sets, named, random_events, spec

from seqspark import count_matches, match, match_at_end, negated_matches, read_stock_events
from seqspark.spec import PatternSpec, Step

ABC, ABPC, APBPC = "a b c", "a b+ c", "a+ b+ c"

# Counts for the worked stream, window 10.
SMALL = [
    (ABC, "any", "all", 15), (ABC, "next", "all", 8), (ABPC, "next", "prefix", 12),
    (ABPC, "any", "all", 28), (APBPC, "any", "all", 61), (ABPC, "any", "maximal", 10),
    (ABPC, "any", "maximal_compact", 10), (APBPC, "any", "maximal", 6),
    (APBPC, "next", "maximal", 6), (ABPC, "next", "maximal", 8),
]


@pytest.mark.parametrize("text,policy,mode,n", SMALL)
def test_worked_stream(spark, text, policy, mode, n):
    df = frame(spark, named(WORKED))
    s = spec(text, 10, policy=policy, mode=mode)
    assert len(id_sets(match(df, s))) == n
    assert count_matches(df, s).first().n_matches == n


# Counts published for a 10,000-event stream; give its path to run them.
LARGE = [
    ("...", "any", "all", {10: 16818, 100: 1814393, 1000: 172342402}),
    ("...", "next", "all", {10: 2929, 100: 3232, 1000: 3232}),
    (".+.", "next", "prefix", {10: 7764, 100: 105723, 1000: 1033717}),
    (".+.", "any", "all", {10: 45502}),
    (".+.", "any", "maximal_compact", {10: 7060, 100: 57831, 1000: 532659}),
    (".+.", "any", "maximal", {10: 7860, 100: 105203, 1000: 1030391}),
    ("++.", "any", "maximal", {10: 4737, 100: 54713, 1000: 528592}),
    ("++.", "next", "maximal", {10: 3268, 100: 32927, 1000: 295815}),
    (".+.", "next", "maximal", {10: 2929, 100: 3232, 1000: 3232}),
]


@pytest.mark.skipif("LETTER_STREAM" not in os.environ, reason="no stream file given")
@pytest.mark.parametrize("shape,policy,mode,counts", LARGE)
def test_published_counts(spark, shape, policy, mode, counts):
    df = read_stock_events(spark, os.environ["LETTER_STREAM"])
    for w, n in counts.items():
        steps = [Step(x, f"symbol = {i}", kleene=k == "+") for i, (x, k) in enumerate(zip("abc", shape))]
        s = PatternSpec(steps, within=w, policy=policy, mode=mode)
        assert count_matches(df, s).first().n_matches == n, w


@pytest.fixture(scope="module", params=[2])
def stream(request, spark):
    events = random_events(request.param, n=140)
    df = frame(spark, events).cache()
    yield events, df
    df.unpersist()


@pytest.mark.parametrize("chunk,salt", [(None, 1), (2, 3)])
def test_any_and_next(stream, chunk, salt):
    events, df = stream
    for text in (ABC, "a b c a") if chunk else ("a b", "c a b"):
        pattern = [(k, False) for k in text.split()]
        s = spec(text, 9, chunk=chunk, salt=salt)
        assert id_sets(match(df, s)) == brute.any_all(events, pattern, 9), text
        assert count_matches(df, s).first().n_matches == len(brute.any_all(events, pattern, 9)), text
    want = brute.following(events, "abc", 9)
    assert {m for m in id_sets(match(df, spec(ABC, 9, policy="next", chunk=chunk)))} == want


@pytest.mark.parametrize("chunk,salt", [(None, 1), (2, 2)])
def test_maximal(stream, chunk, salt):
    events, df = stream
    texts = (ABPC, APBPC, "a+ b c") if chunk else ("a+ c", "a b+ c+ a", "a+ b+ c+ n", "a b n+ c")
    for text in texts:
        pattern = [(x.strip("+"), x.endswith("+")) for x in text.split()]
        s = spec(text, 9, mode="maximal", chunk=chunk, salt=salt)
        want = brute.maximal(events, pattern, 9)
        assert id_sets(match(df, s)) == want, text
        assert count_matches(df, s).first().n_matches == len(want), text


def test_compact_and_subsets(stream):
    events, df = stream
    assert id_sets(match(df, spec(ABPC, 9, mode="maximal_compact"))) == brute.compact(events, *"abc", 9)
    for text in (ABPC, APBPC, "a+ b"):
        pattern = [(x.strip("+"), x.endswith("+")) for x in text.split()]
        s = spec(text, 6, mode="all")
        want = brute.any_all(events, pattern, 6)
        assert id_sets(match(df, s)) == want, text
        assert count_matches(df, s).first().n_matches == len(want), text


def test_prefix(stream):
    events, df = stream
    got = id_sets(match(df, spec(ABPC, 9, policy="next", mode="prefix")))
    assert got == brute.prefixes(events, *"abc", 9)


def test_next_maximal(stream):
    events, df = stream
    for text in (APBPC, "a+ c", "a b+ c b"):
        pattern = [(x.strip("+"), x.endswith("+")) for x in text.split()]
        want = brute.first_ends(events, brute.maximal(events, pattern, 9))
        got = id_sets(match(df, spec(text, 9, policy="next", mode="maximal")))
        assert got == want, text


def test_next_maximal_single_kleene_is_one_per_start(stream):
    events, df = stream
    runs = brute.following(events, "abc", 9)
    got = id_sets(match(df, spec(ABPC, 9, policy="next", mode="maximal")))
    assert {(m[0], m[-1]) for m in got} == {(m[0], m[-1]) for m in runs}
    assert got <= brute.maximal(events, [("a", False), ("b", True), ("c", False)], 9)


def test_contiguous(stream):
    events, df = stream
    for text in (ABC, ABPC, APBPC, "b+ c", "c a+ b"):
        pattern = [(x.strip("+"), x.endswith("+")) for x in text.split()]
        got = id_sets(match(df, spec(text, 9, policy="contiguous", chunk=1 if "+" in text else None)))
        assert got == brute.adjacent(events, pattern, 9), text


def test_negation(stream):
    events, df = stream
    kept, lost = brute.negation(events, *"anc", 6)
    s = spec("a !n c", 6, chunk=2)
    assert id_sets(match(df, s)) == kept
    assert id_sets(negated_matches(df, s)) == lost


def test_match_at_end(stream):
    events, df = stream
    ends = df.filter("kind = 'c' AND event_id % 2 = 0").selectExpr("event_id AS end_id")
    for s in (spec(ABC, 9), spec(ABPC, 9, mode="maximal"), spec(ABC, 9, policy="next")):
        whole = id_sets(match(df, s))
        assert id_sets(match_at_end(df, s, ends)) == {m for m in whole if m[-1] % 2 == 0}


def test_unpartitioned(spark):
    events = [{**e, "key": 0} for e in random_events(5, n=60)]
    df = frame(spark, events)
    for text in (ABC, ABPC):
        pattern = [(x.strip("+"), x.endswith("+")) for x in text.split()]
        s = spec(text, 5, mode="maximal", partition_by=[])
        assert id_sets(match(df, s)) == brute.maximal(events, pattern, 5)


def test_subset_guard(spark):
    df = frame(spark, named(["a1", *[f"b{i}" for i in range(2, 20)], "c20"]))
    with pytest.raises(Exception, match="subsets"):
        match(df, spec(ABPC, 50, max_subset_candidates=4)).collect()
    assert count_matches(df, spec(ABPC, 50)).first().n_matches == 2**18 - 1


def test_only_valid_subsets_grow(spark):
    """Eighteen falling candidates under a rising condition: the valid sets are those of one event."""
    events = [{"event_id": i, "ts": i, "kind": k, "key": 1, "v": 100 - i} for i, k in enumerate("a" + "b" * 18 + "c", 1)]
    df = spark.createDataFrame(events, "event_id long, ts long, kind string, key int, v int")
    b = Step("b", "kind = 'b'", kleene=True, iter_when=lambda e, last: e["v"] > last["v"])
    s = PatternSpec([Step("a", "kind = 'a'"), b, Step("c", "kind = 'c'")], within=50, payload=["v"])
    assert id_sets(match(df, s)) == {(1, i, 20) for i in range(2, 20)}


def test_average_skips_nulls(spark):
    rows = [(1, 1, "a", None), (2, 2, "b", 4), (3, 3, "b", None), (4, 4, "b", 6), (5, 5, "c", None)]
    df = spark.createDataFrame(rows, "event_id long, ts long, kind string, v int")
    b = Step("b", "kind = 'b'", kleene=True, agg_when=lambda e, s: (s["n"] == 0) | (e["v"] > s["total"] / s["n"]), agg_on="v")
    s = PatternSpec([Step("a", "kind = 'a'"), b, Step("c", "kind = 'c'")], within=50, payload=["v"])
    assert (1, 2, 4, 5) in id_sets(match(df, s))


def test_condition_may_be_a_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def is_b(kind: pd.Series) -> pd.Series:
        return kind.str.upper() == "B"

    df = frame(spark, named(WORKED))
    steps = [Step("a", "kind = 'a'"), Step("b", is_b("kind")), Step("c", "kind = 'c'")]
    assert len(id_sets(match(df, PatternSpec(steps, within=10)))) == 15


@pytest.mark.parametrize("chunk", [None, 3])
def test_counts_without_lists(spark, stream, chunk):
    events, df = stream
    w = 9
    cases = [
        ("a b c", "any", "all", len(brute.any_all(events, [("a", False), ("b", False), ("c", False)], w))),
        ("a b c a", "any", "all", len(brute.any_all(events, [(x, False) for x in "abca"], w))),
        ("a b+ c", "any", "maximal_compact", len(brute.compact(events, "a", "b", "c", w))),
        ("a+ b+ c", "any", "maximal", len(brute.maximal(events, [("a", True), ("b", True), ("c", False)], w))),
        ("a b+ c", "next", "prefix", len(brute.prefixes(events, "a", "b", "c", w))),
        ("a !n c", "any", "all", len(brute.negation(events, "a", "n", "c", w)[0])),
    ]
    for text, policy, mode, n in cases:
        s = spec(text, w, policy=policy, mode=mode).but(chunk=chunk)
        assert n and count_matches(df, s).first().n_matches == n, text


def test_a_pattern_without_keys_is_spread_however_small_its_input(spark):
    events = random_events(6, n=90, keys=1, span=900)
    df, s = frame(spark, events).coalesce(1), spec("a b c", 90, partition_by=[])
    m = match(df, s)
    # a number of partitions that is asked for is one that Spark does not merge
    assert "REPARTITION_BY_NUM" in m._jdf.queryExecution().toString()
    abc = [sorted((e["t"], e["id"]) for e in events if e["kind"] == k) for k in "abc"]
    want = {(a[1], b[1], c[1]) for a in abc[0] for b in abc[1] for c in abc[2] if a[0] < b[0] < c[0] <= a[0] + 90}
    assert want and id_sets(m) == want and {r.n_events for r in m.select("n_events").collect()} == {3}


def test_a_pattern_without_keys_lists_its_matches_from_sorted_events(spark, monkeypatch):
    from seqspark.operators import combos

    monkeypatch.setattr(combos, "ENDS_A_GROUP", 2)
    events = [{**e, "key": 0} for e in random_events(7, n=70)]
    df, ends = frame(spark, events), frame(spark, events).filter("event_id % 2 = 0").selectExpr("event_id AS end_id")
    for text, w in (("a c", 6), (ABC, 7), ("a b c a", 9), ("a b c", 0)):
        s, want = spec(text, w, partition_by=[]), brute.any_all(events, [(x, False) for x in text.split()], w)
        assert id_sets(match(df, s)) == want and bool(want) == (w > 0)
        assert id_sets(match_at_end(df, s, ends)) == {m for m in want if m[-1] % 2 == 0}
        # every event twice: a match once per choice of copies
        assert match(df.union(df), s).count() == len(want) * 2 ** len(text.split())
    kept, lost = brute.negation(events, *"anc", 6)
    s = spec("a !n c", 6, partition_by=[])
    assert id_sets(match(df, s)) == kept and id_sets(negated_matches(df, s)) == lost


def test_a_pattern_without_keys_makes_times_per_event_and_tests_no_start_in_vain(spark):
    df = frame(spark, random_events(8)).selectExpr("*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, ts) AS at")
    m = match(df, spec(ABC, "5 min", partition_by=[], ts="at"))
    plan = m.select("start_ts", "end_ts")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Generate" in above and "convert_timezone" not in above
    assert m.schema["start_ts"].dataType.simpleString() == "timestamp_ntz" and m.schema["a"].dataType.names == ["t", "id"]
