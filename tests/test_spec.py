from datetime import timedelta

import pytest
from helpers import spec, step

from seqspark.spec import PatternSpec, Step, micros, same_attribute


@pytest.mark.parametrize(
    "text,want",
    [("5 ms", 5_000), ("2 s", 2_000_000), ("10 min", 600_000_000), ("1 h", 3_600_000_000),
     ("2 days", 172_800_000_000), ("3 seconds", 3_000_000), (timedelta(hours=1), 3_600_000_000)],
)
def test_durations(text, want):
    assert micros(text) == want


def test_bad_duration():
    with pytest.raises(ValueError):
        micros("10 parsecs")


def test_rejected_patterns():
    bad = [
        dict(steps=[step("a"), step("a")]),
        dict(steps=[step("a")]),
        dict(steps=[step("a"), step("b", negated=True)]),
        dict(steps=[step("a"), step("b", kleene=True)]),
        dict(steps=[step("a"), step("b", negated=True), step("c", negated=True), step("d")]),
        dict(steps=[step("a", kleene=True), step("b")], policy="any", mode="prefix"),
        dict(steps=[step("a", kleene=True), step("b")], policy="next", mode="all"),
        dict(steps=[step("a"), step("b")], policy="some"),
        dict(steps=[step("a"), Step("b", "true", iter_when=lambda c, p: c["t"] > p["t"])]),
    ]
    for kw in bad:
        with pytest.raises(ValueError):
            PatternSpec(within=5, **kw)


def test_same_adds_keys():
    assert same_attribute(spec("a b", 5), "city").keys == ["key", "city"]


def test_window_must_fit_time_type(spark):
    from seqspark import match

    df = spark.createDataFrame([(1, 1, "a", 0)], "event_id long, ts long, kind string, key long")
    with pytest.raises(ValueError):
        match(df, spec("a b", "5 s"))
