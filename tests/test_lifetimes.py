"""Lifetimes of matches over portions of arrivals, by matching every portion on its own."""

import pytest
from helpers import frame, random_events, spec
from pyspark.sql import functions as F

from seqspark import (
    changelog_accuracy,
    first_last_per_end,
    match,
    match_lifetimes,
    match_provenance,
    match_status,
    portion_changelog,
)

PORTIONS = 3
CASES = [
    ("a b c", "any", "all"),
    ("a b+ c", "any", "all"),
    ("a b+ c", "any", "maximal"),
    ("a b+ c", "any", "maximal_compact"),
    ("a+ b+ c", "any", "maximal"),
    ("a b c", "next", "all"),
    ("a b+ c", "next", "prefix"),
    ("a b+ c", "next", "maximal"),
    ("a+ b+ c", "next", "maximal"),
    ("a b c", "contiguous", "all"),
    ("a !n c", "any", "all"),
    ("a !n c", "next", "all"),
]


def arrivals(seed, n=70, kinds="abcn"):
    """Events in order of arrival, some of them late by several portions."""
    events = random_events(seed, n=n, keys=2, span=60, kinds=kinds)
    order = sorted(events, key=lambda e: (e["t"] + (45 if e["id"] % 7 == 0 else e["id"] * 31 % 9), e["id"]))
    for k, e in enumerate(order):
        e["seq"], e["portion"] = k + 1, k * PORTIONS // n
    return order


def table(spark, events):
    extra = spark.createDataFrame([(e["id"], e["seq"], e["portion"], e["id"] % 7 == 0) for e in events], "event_id long, arrival_seq long, portion int, is_late boolean")
    return frame(spark, events).join(extra, "event_id")


def by_portion(spark, events, s):
    """ids -> the portions after which the match stands."""
    out = {}
    for n in range(PORTIONS):
        for r in match(frame(spark, [e for e in events if e["portion"] <= n]), s).select("key", "end_id", "event_ids").collect():
            out.setdefault((r.key, r.end_id, tuple(r.event_ids)), []).append(n)
    return out


@pytest.mark.parametrize("text,policy,mode", CASES)
def test_lifetimes_equal_matching_every_portion(spark, text, policy, mode):
    events, s = arrivals(len(text) + len(mode)), spec(text, 9, policy=policy, mode=mode)
    life = match_lifetimes(table(spark, events), s).persist()
    stands = by_portion(spark, events, s)
    rows = life.select("key", "end_id", "event_ids", "born", "last").collect()
    got = {(r.key, r.end_id, tuple(r.event_ids)): (r.born, r.last) for r in rows}
    assert len(got) == len(rows)
    assert got == {k: (min(v), None if max(v) == PORTIONS - 1 else max(v)) for k, v in stands.items()}

    # the changelog, folded by hand after every portion
    log, now = sorted(portion_changelog(life, s).collect(), key=lambda r: r.revision), {}
    for n in range(PORTIONS):
        for r in [r for r in log if r.revision == n]:
            ident = (r.key, r.end_id, r.match_id)
            if r.kind == "delete":
                del now[ident]
            else:
                if r.kind == "update":
                    del now[r.key, r.end_id, r.old_match_id]
                now[ident] = (r.key, r.end_id, tuple(r.event_ids))
        assert set(now.values()) == {k for k, v in stands.items() if n in v}
    life.unpersist()


def test_accuracy_falls_when_the_changelog_is_broken(spark):
    events, s = arrivals(5, kinds="abc"), spec("a b+ c", 20, mode="maximal")
    log = portion_changelog(match_lifetimes(table(spark, events), s), s).persist()
    truth = match(frame(spark, events), s).select(F.lit("q").alias("query_id"), "match_id", "event_ids")

    def score(log):
        r = changelog_accuracy({"q": log}, {"q": s}, truth).first()
        return r["precision"], r["recall"]

    assert score(log) == (1.0, 1.0)
    assert log.where("kind <> 'insert'").count() > 0
    untaken = log.withColumn("kind", F.lit("insert")).withColumn("old_match_id", F.lit(None).cast("long"))
    assert score(untaken)[0] < 1
    assert score(log.where("kind = 'insert'"))[1] < 1
    # without correction every version stays
    assert score(portion_changelog(match_lifetimes(table(spark, events), s), s, False))[0] < 1
    log.unpersist()


@pytest.mark.parametrize("text,policy,mode", [CASES[0], CASES[4], CASES[6], CASES[9]])
def test_provenance_is_the_last_arriving_event(spark, text, policy, mode):
    events, s = arrivals(3), spec(text, 9, policy=policy, mode=mode)
    seq = {e["id"]: e["seq"] for e in events}
    rows = match_provenance(table(spark, events), s).collect()
    assert len(rows) == match(frame(spark, events), s).count()
    for r in rows:
        last = max(r.event_ids, key=seq.get)
        assert (r.arrived, r.is_ooo) == (seq[last], last % 7 == 0)


def test_status_tells_how_a_match_was_published(spark):
    s = spec("a b+ c", 20, mode="maximal")
    names = "a1 b3 c5 b4 a7 c9 b8".split()  # b4 corrects a match, b8 completes one late
    events = [{"id": i, "t": int(n[1:]), "kind": n[0], "key": 0, "seq": i, "portion": i // 3} for i, n in enumerate(names)]
    df = table(spark, events).withColumn("is_late", F.col("event_id").isin(3, 6))
    log = portion_changelog(match_lifetimes(df, s), s)
    out = match_status(log, ["key"], match_provenance(df, s)).collect()
    got = {tuple(r.event_ids): (r.status, r.emitted_at, r.gone_at) for r in out}
    assert got == {
        (0, 1, 2): ("emitted", 0, 1), (0, 1, 3, 2): ("updated", 1, None), (0, 1, 3, 5): ("emitted", 1, 2), (0, 1, 3, 6, 5): ("updated", 2, None),
        (4, 6, 5): ("late", 2, None),
    }


@pytest.mark.parametrize("chunk", [None, 2, 50])
def test_window_ends_by_scan(spark, chunk):
    events, w = random_events(6, n=200, keys=2, span=60), 8
    s = spec("a b+ c", w, mode="maximal").but(chunk=chunk)
    rows = first_last_per_end(frame(spark, events), s).collect()
    ends = [e for e in events if e["kind"] == "c"]
    assert len(rows) == len(ends)
    got = {r.end_id: r for r in rows}
    for c in ends:
        r = got[c["id"]]
        assert r.end_ts == c["t"]
        for kind in "ab":
            own = [(e["t"], e["id"]) for e in events if e["key"] == c["key"] and e["kind"] == kind and c["t"] - w <= e["t"] < c["t"]]
            for name, of in (("first", min), ("last", max)):
                found = r[f"{name}_{kind}"]
                assert (found and (found.ts, found.id)) == (of(own) if own else None)


def test_nothing_to_find(spark):
    s, none = spec("a b+ c", 9, mode="maximal"), table(spark, arrivals(1)).limit(0)
    assert match_lifetimes(none, s).count() == 0 and portion_changelog(match_lifetimes(none, s), s).count() == 0
    assert first_last_per_end(none, s).count() == 0 and match_provenance(none, s).count() == 0
