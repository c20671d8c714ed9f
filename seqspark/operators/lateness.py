"""Late events: who is late, how badly, and which ends they touch.

``arrival_seq`` holds the order of arrival.  All running values use it in two levels (see
``plans.scans``), because a few event types share all rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_ticks, from_ticks, in_ms, ticks
from ..plans.base import as_column, prepare
from ..plans.joins import early_side, end_side
from ..plans.scans import running
from ..spec import PatternSpec
from .match import match_at_end
from .near import near_ends

IN_ORDER, MINOR, LATE = "in_order", "minor", "late"
ARRIVALS = 1_000_000


def running_max_ts(df: DataFrame, by=("source", "event_type"), *, ts="ts", order="arrival_seq", chunk=ARRIVALS):
    """The latest event time seen so far among the rows with the same ``by``."""
    timed = df.withColumn("_t", ticks(df, ts))
    out = running(timed, list(by), order, chunk, {"_max": ("max", F.col("_t"), False)})
    return out.withColumn("max_ts", from_ticks(df, ts, F.col("_max"))).drop("_t", "_max")


def classify_lateness(
    df: DataFrame, sources: DataFrame, by=("source", "event_type"), *, ts="ts", order="arrival_seq", chunk=ARRIVALS,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add ``lateness_ms``, ``est_interval_ms``, ``status`` and ``is_late``.

    An event is in order when its time is the running maximum of its source and type.
    ``sources`` is a small table (source, event_type, est_interval_ms): an event late by
    less than the interval is only ``minor``.  ``state`` (by, latest) holds the latest tick of
    arrivals before these.
    """
    timed = df.withColumn("_t", ticks(df, ts))
    out = running(timed, list(by), order, chunk, {"_max": ("max", F.col("_t"), False)})
    if state is not None:
        out = out.join(state, list(by), "left").withColumn("_max", F.greatest("_max", "latest")).drop("latest")
    out = out.withColumn("lateness_ms", in_ms(df, ts, F.col("_max") - F.col("_t"))).drop("_t", "_max")
    known = [c for c in sources.columns if c != "est_interval_ms"]
    out = out.join(sources, known, "left")
    lag = F.col("lateness_ms")
    status = F.when(lag == 0, IN_ORDER).when(lag < F.coalesce("est_interval_ms", F.lit(0)), MINOR).otherwise(LATE)
    return out.withColumn("status", status).withColumn("is_late", F.col("status") == LATE)


def observed_intervals(df: DataFrame, by=("event_type",), *, ts="ts") -> DataFrame:
    """Mean gap between events per type (``actual_interval_ms``)."""
    t = ticks(df, ts)
    gap = (F.max(t) - F.min(t)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    return df.groupBy(*by).agg(in_ms(df, ts, gap).alias("actual_interval_ms"))


def lateness_score(
    df: DataFrame, within: timedelta | str | int, a: float = 1.0, b: float = 0.0, c: float = 0.0,
    actual: DataFrame | None = None, *, ts="ts",
) -> DataFrame:
    """Score late events: a ln(1 + lateness + interval) + b (actual - interval)^2 + c interval / window.

    ``actual`` (from :func:`observed_intervals`) switches the second term on.  In-order
    events score 0, minor ones have no score.
    """
    window = in_ms(df, ts, F.lit(float(duration_ticks(df, ts, within))))
    rate = F.coalesce(F.col("est_interval_ms"), F.lit(0)).cast("double")
    gap = F.lit(0.0)
    out = df
    if actual is not None:
        out = out.join(actual, [x for x in actual.columns if x != "actual_interval_ms"], "left")
        gap = F.coalesce(F.col("actual_interval_ms") - rate, F.lit(0.0))
    score = a * F.log1p(F.col("lateness_ms") + rate) + b * F.pow(gap, F.lit(2.0)) + c * rate / window
    return out.withColumn("score", F.when(F.col("status") == LATE, score).when(F.col("status") == IN_ORDER, 0.0))


def adaptive_threshold(
    df: DataFrame, factor: float = 1.0, by=("event_type",), *, order="arrival_seq", chunk=ARRIVALS,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add ``threshold`` (mean score of the type's late events so far, times ``factor``)
    and ``accepted``: late events pass while their score is at most the threshold.
    ``state`` (by, total, n) holds the scores of arrivals before these."""
    late = F.col("status") == LATE
    score = F.when(late, F.col("score"))
    measures = {"_sum": ("sum", score, False), "_n": ("sum", F.when(late, F.lit(1)), False)}
    out = running(df, list(by), order, chunk, measures)
    if state is not None:
        out = out.join(state, list(by), "left")
        sums = {"_sum": F.col("_sum") + F.coalesce("total", F.lit(0.0)), "_n": F.col("_n") + F.coalesce("n", F.lit(0))}
        out = out.withColumns(sums).drop("total", "n")
    out = out.withColumn("threshold", F.when(late, F.col("_sum") / F.col("_n") * factor)).drop("_sum", "_n")
    return out.withColumn("accepted", ~late | (F.col("score") <= F.col("threshold")))


def discard_too_late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by ``accepted``."""
    return df.filter("accepted"), df.filter(~F.col("accepted"))


def watermark_delay(stats: DataFrame, within_ms: float) -> DataFrame:
    """How long to wait for stragglers: min(max lateness, late share x window) / 10 once
    more than a tenth of the events is late.  Input and output have one row."""
    share = F.col("late_events") / F.col("events")
    slack = F.least(F.coalesce("max_lateness_ms", F.lit(0.0)), share * within_ms) / 10
    return stats.select(F.when(share > 0.1, F.floor(slack)).otherwise(0).cast("long").alias("delay_ms"))


def affected_range(
    late: DataFrame, spec: PatternSpec, oldest: Column | None = None, latest: Column | None = None
) -> DataFrame:
    """Add ``from_ts`` and ``to_ts``: where ends touched by a late event may lie.

    The range depends on the position of the step the event fits: the first step looks one
    window ahead, the last one window back, a one-or-more step almost a window to both
    sides, a middle step by its place.  ``oldest``/``latest`` clamp to the time seen.
    """
    steps = spec.positive
    n = len(steps)
    w = duration_ticks(late, spec.ts, spec.within)
    t = ticks(late, spec.ts)
    part = w // n
    lows, highs = [], []
    for i, s in enumerate(steps):
        if i == 0:
            lo, hi = t, t + w
        elif i == n - 1:
            lo, hi = t - w, t
        elif s.kleene:
            lo, hi = t - w + w // 100, t + w
        else:
            lo, hi = t - w + (n - i - 1) * part, t + w - i * part
            if latest is not None:
                hi = F.greatest(hi, latest)
        fits = F.coalesce(as_column(s.when), F.lit(False))
        lows.append(F.when(fits, lo))
        highs.append(F.when(fits, hi))
    lo, hi = F.least(*lows), F.greatest(*highs)
    if oldest is not None:
        lo = F.greatest(lo, oldest)
    if latest is not None:
        hi = F.least(hi, latest)
    out = late.withColumn("from_ts", from_ticks(late, spec.ts, lo))
    return out.withColumn("to_ts", from_ticks(late, spec.ts, hi))


def affected_ends(late: DataFrame, events: DataFrame, spec: PatternSpec) -> DataFrame:
    """End events whose matches a late event can change (keys and ``end_id``).

    That is the part of :func:`affected_range` that shares a window with the late event:
    the ends up to one window after it, and the event itself when it is an end.
    """
    last = spec.positive[-1]
    p = prepare(late, spec, keep_all=spec.policy == "contiguous")
    q = prepare(events, spec)
    width = max(1, p.within)
    ends = q.rows(last).select(*spec.keys, F.col("_e")["t"].alias("_t"), F.col("_e")["id"].alias("end_id"))
    own = p.rows(last).select(*spec.keys, F.col("_e")["id"].alias("end_id"))
    touched = p.df.select(*spec.keys, F.col("_e")["t"].alias("_late")).distinct()
    pairs = end_side(ends, F.col("_t"), width).join(early_side(touched, F.col("_late"), width), [*spec.keys, "_k"])
    near = (F.col("_late") < F.col("_t")) & (F.col("_t") - F.col("_late") <= p.within)
    return pairs.filter(near).select(*spec.keys, "end_id").union(own).distinct()


def rematch(events: DataFrame, ends: DataFrame, spec: PatternSpec) -> DataFrame:
    """Recompute the matches of the given ends from the events around them."""
    return match_at_end(near_ends(events, ends, spec), spec, ends, near=True)
