"""Late events and corrections: every fifth event arrives up to ten hours late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ticks
from ..operators import (
    adaptive_threshold,
    affected_ends,
    affected_range,
    apply_changelog,
    classify_lateness,
    diff_matches,
    discard_too_late,
    event_stats,
    expire_events,
    expire_matches,
    global_stats,
    invalidate,
    lateness_score,
    match,
    observed_intervals,
    rematch,
    stats_rollup,
    watermark_delay,
)
from ..sources import EventSource, source_table
from .matching import COMPACT, MAXIMAL, any_sql, next_sql
from .registry import ARR, A, B, C, arrivals, events, flat, ids, pattern, query

TYPES = ("view", "click", "purchase", "signup", "error")
RATE = {t: (i + 1) * 3_600_000 for i, t in enumerate(TYPES)}
RATES = ", ".join(f"('{t}', {r})" for t, r in RATE.items())


def rates(spark):
    rows = [EventSource("web", [t], r) for t, r in RATE.items()]
    return source_table(spark, rows).drop("source")


def classified(spark, d):
    return classify_lateness(arrivals(spark, d), rates(spark), chunk=1000)


LATE = f"""{ARR}, mx AS (SELECT *, max(ts) OVER (PARTITION BY source, event_type ORDER BY arrival_seq) AS max_ts FROM arr),
cl AS (SELECT mx.*, r.est_interval_ms, (epoch_us(max_ts) - epoch_us(ts)) / 1000.0::DOUBLE AS lateness_ms
  FROM mx JOIN (VALUES {RATES}) r(event_type, est_interval_ms) USING (event_type)),
st AS (SELECT *, CASE WHEN lateness_ms = 0 THEN 'in_order' WHEN lateness_ms < est_interval_ms THEN 'minor'
  ELSE 'late' END AS status FROM cl),
sc AS (SELECT *, CASE status WHEN 'late' THEN ln(1 + lateness_ms + est_interval_ms)
  + 2 * est_interval_ms / 259200000.0::DOUBLE WHEN 'in_order' THEN 0 END AS score FROM st),
th AS (SELECT *, CASE WHEN status = 'late' THEN avg(CASE WHEN status = 'late' THEN score END) OVER (
  PARTITION BY event_type ORDER BY arrival_seq) END AS threshold FROM sc),
ok AS (SELECT *, status <> 'late' OR score <= threshold * 1.02 AS accepted FROM th)"""


def scored(spark, d):
    return lateness_score(classified(spark, d), "3 d", a=1.0, c=2.0)


def gated(spark, d):
    return adaptive_threshold(scored(spark, d), 1.02, chunk=1000)


@query(
    "classify_lateness",
    f"WITH {LATE} SELECT event_id, lateness_ms, status, status = 'late' AS is_late FROM st",
)
def q_classify(spark, d):
    return classified(spark, d).select("event_id", "lateness_ms", "status", "is_late")


@query("lateness_score", f"WITH {LATE} SELECT event_id, round(score, 6) AS score FROM sc")
def q_score(spark, d):
    return scored(spark, d).select("event_id", F.round("score", 6).alias("score"))


@query(
    "lateness_score_observed",
    f"""WITH {LATE}, gap AS (SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / (count(*) - 1) / 1000.0::DOUBLE
      AS actual FROM arr GROUP BY 1)
    SELECT event_id, CASE status WHEN 'late' THEN round(ln(1 + lateness_ms + est_interval_ms)
      + 1e-15 * pow(actual - est_interval_ms, 2), 5) WHEN 'in_order' THEN 0 END AS score FROM st JOIN gap USING (event_type)""",
)
def q_score_observed(spark, d):
    late = classified(spark, d)
    out = lateness_score(late, "3 d", 1.0, 1e-15, 0.0, observed_intervals(late))
    return out.select("event_id", F.round("score", 5).alias("score"))


@query(
    "adaptive_threshold",
    f"WITH {LATE} SELECT event_id, round(threshold * 1.02, 6) AS threshold, accepted FROM ok",
)
def q_threshold(spark, d):
    return gated(spark, d).select("event_id", F.round("threshold", 6).alias("threshold"), "accepted")


for side in (0, 1):
    name, test = ("kept", "accepted") if side == 0 else ("dropped", "NOT accepted")
    query(f"discard_too_late_{name}", f"WITH {LATE} SELECT event_id, status FROM ok WHERE {test}")(
        lambda spark, d, side=side: discard_too_late(gated(spark, d))[side].select("event_id", "status")
    )

STATS = """count(*) AS events, count(*) FILTER (status = 'late') AS late_events,
    round(avg(lateness_ms), 3) AS avg_lateness_ms, min(lateness_ms) FILTER (status = 'late') AS min_lateness_ms,
    max(lateness_ms) FILTER (status = 'late') AS max_lateness_ms,
    round(avg(score) FILTER (status = 'late'), 6) AS avg_score"""


def rounded(df):
    return df.withColumns(
        {"avg_lateness_ms": F.round("avg_lateness_ms", 3), "avg_score": F.round("avg_score", 6)}
    )


@query(
    "event_stats",
    f"WITH {LATE} SELECT event_type, {STATS}, max(est_interval_ms) AS est_interval_ms FROM sc GROUP BY event_type",
)
def q_event_stats(spark, d):
    out = rounded(event_stats(scored(spark, d)))
    return out.withColumn("est_interval_ms", F.col("est_interval_ms").cast("int"))


@query(
    "global_stats",
    f"""WITH {LATE} SELECT {STATS}, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9)
    AS events_per_sec FROM sc""",
)
def q_global_stats(spark, d):
    return rounded(global_stats(scored(spark, d))).withColumn("events_per_sec", F.round("events_per_sec", 9))


@query("stats_rollup", f"WITH {LATE} SELECT event_type, {STATS} FROM sc GROUP BY ROLLUP (event_type)")
def q_stats_rollup(spark, d):
    return rounded(stats_rollup(scored(spark, d)))


@query(
    "watermark_delay",
    f"""WITH {LATE}, g AS (SELECT {STATS} FROM sc) SELECT CASE WHEN late_events / events > 0.1 THEN CAST(floor(
    least(max_lateness_ms, late_events / events * 259200000.0::DOUBLE) / 10) AS BIGINT) ELSE 0 END AS delay_ms FROM g""",
)
def q_watermark(spark, d):
    return watermark_delay(global_stats(scored(spark, d)), 259_200_000.0)


@query(
    "affected_range",
    """SELECT event_id, greatest(lo, oldest) AS from_ts, least(hi, latest) AS to_ts FROM (
    SELECT event_id, oldest, latest, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts - INTERVAL 3 DAY + INTERVAL 1 DAY
      ELSE ts - INTERVAL 3 DAY END AS lo,
      CASE event_type WHEN 'view' THEN ts + INTERVAL 3 DAY WHEN 'click' THEN greatest(ts + INTERVAL 3 DAY - INTERVAL 1 DAY, latest)
      ELSE ts END AS hi
    FROM (SELECT * , (SELECT max(ts) FROM events) AS latest, (SELECT min(ts) FROM events) AS oldest FROM events
      WHERE event_id % 5 = 0 AND event_type IN ('view', 'click', 'purchase')))""",
)
def q_range(spark, d):
    e = events(spark, d)
    t = ticks(e, "ts")
    seen = e.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    late = e.filter("event_id % 5 = 0 AND event_type IN ('view', 'click', 'purchase')")
    lo, hi = seen.select("lo").scalar(), seen.select("hi").scalar()
    return affected_range(late, pattern(A(), B(), C()), lo, hi).select("event_id", "from_ts", "to_ts")


@query(
    "affected_range_kleene",
    """SELECT event_id, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts - INTERVAL 3 DAY
      + to_microseconds(259200000000 // 100) ELSE ts - INTERVAL 3 DAY END AS from_ts,
    CASE event_type WHEN 'purchase' THEN ts ELSE ts + INTERVAL 3 DAY END AS to_ts
    FROM events WHERE event_id % 5 = 0 AND event_type IN ('view', 'click', 'purchase')""",
)
def q_range_kleene(spark, d):
    late = events(spark, d).filter("event_id % 5 = 0 AND event_type IN ('view', 'click', 'purchase')")
    spec = pattern(A(), B(kleene=True), C(), mode="maximal")
    return affected_range(late, spec).select("event_id", "from_ts", "to_ts")


ENDS = """SELECT DISTINCT c.user_id, c.event_id AS end_id FROM events c JOIN events l ON c.user_id = l.user_id
    AND l.event_id % 5 = 0 AND l.event_type IN ('view', 'click', 'purchase')
    AND c.ts <= l.ts + INTERVAL 3 DAY AND (l.ts < c.ts OR l.event_id = c.event_id) WHERE c.event_type = 'purchase'"""


def touched(spark, d, spec):
    e = events(spark, d)
    return affected_ends(e.filter("event_id % 5 = 0"), e, spec)


@query("affected_ends", ENDS)
def q_ends(spark, d):
    return touched(spark, d, pattern(A(), B(), C()))


for policy, sql in (("any", any_sql(3)), ("next", next_sql(3))):
    query(f"rematch_{policy}", f"SELECT * FROM ({sql}) WHERE end_id IN (SELECT end_id FROM ({ENDS}))")(
        lambda spark, d, policy=policy: flat(
            rematch(
                events(spark, d),
                touched(spark, d, pattern(A(), B(), C())),
                pattern(A(), B(), C(), policy=policy),
            )
        )
    )


def old_and_new(spark, d, spec):
    e = events(spark, d)
    return match(e.filter("event_id % 5 <> 0"), spec), match(e, spec)


def on_time(sql: str) -> str:
    """The same SQL over the events that were on time."""
    return sql.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 5 <> 0)")


CHANGES = """old_m AS ({old}), new_m AS ({new}),
gone AS (SELECT o.* FROM old_m o ANTI JOIN new_m n ON o.end_id = n.end_id AND o.ids = n.ids),
come AS (SELECT n.* FROM new_m n ANTI JOIN old_m o ON o.end_id = n.end_id AND o.ids = n.ids),
up AS (SELECT g.ids AS old_ids, k.ids, k.user_id, k.start_ts, k.end_ts, k.end_id FROM gone g JOIN come k
  ON g.end_id = k.end_id AND split_part(g.ids, ',', 1) = split_part(k.ids, ',', 1)
  AND list_has_all(string_split(k.ids, ','), string_split(g.ids, ',')) AND k.n_events > g.n_events),
log AS (SELECT 'update' AS kind, user_id, end_id, ids FROM up
  UNION ALL SELECT 'insert', user_id, end_id, ids FROM come WHERE (end_id, ids) NOT IN (SELECT (end_id, ids) FROM up)
  UNION ALL SELECT 'delete', user_id, end_id, ids FROM gone WHERE (end_id, ids) NOT IN (SELECT (end_id, old_ids) FROM up))"""


def changes(log):
    return log.select("kind", "user_id", "end_id", ids())


for mode, sql in (("maximal", MAXIMAL), ("maximal_compact", COMPACT)):
    query(f"diff_matches_{mode}", f"WITH {CHANGES.format(old=on_time(sql), new=sql)} SELECT * FROM log")(
        lambda spark, d, mode=mode: changes(
            diff_matches(*old_and_new(spark, d, pattern(A(), B(kleene=True), C(), mode=mode)), ["user_id"])
        )
    )
    query(f"apply_changelog_{mode}", sql)(
        lambda spark, d, mode=mode: folded(spark, d, pattern(A(), B(kleene=True), C(), mode=mode))
    )


def folded(spark, d, spec):
    old, new = old_and_new(spark, d, spec)
    log = diff_matches(old, new, ["user_id"]).withColumn("revision", F.lit(1).cast("long"))
    return flat(apply_changelog(old, log, ["user_id"]))


@query(
    "diff_matches_no_correction",
    f"WITH {CHANGES.format(old=on_time(MAXIMAL), new=MAXIMAL)} SELECT 'insert' AS kind, user_id, end_id, ids FROM come",
)
def q_no_correction(spark, d):
    old, new = old_and_new(spark, d, pattern(A(), B(kleene=True), C(), mode="maximal"))
    return changes(diff_matches(old, new, ["user_id"], with_correction=False))


@query(
    "invalidate",
    f"""WITH o AS ({on_time(next_sql(3))}), n AS ({next_sql(3)}), al AS (SELECT * FROM o UNION ALL SELECT * FROM n)
    SELECT 'delete' AS kind, user_id, end_id, ids FROM o WHERE EXISTS (SELECT 1 FROM al WHERE al.user_id = o.user_id
      AND split_part(al.ids, ',', 1) = split_part(o.ids, ',', 1) AND split_part(al.ids, ',', 2) = split_part(o.ids, ',', 2)
      AND al.end_ts < o.end_ts)""",
)
def q_invalidate(spark, d):
    old, new = old_and_new(spark, d, pattern(A(), B(), C(), policy="next"))
    return changes(invalidate(old, new, ["user_id"]))


@query(
    "expire_events",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 DAY",
)
def q_expire_events(spark, d):
    e = events(spark, d)
    now = e.agg(F.max(ticks(e, "ts"))).scalar()
    return expire_events(e, now, pattern(A(), B(), C())).select("event_id", "ts")


@query(
    "expire_matches",
    f"SELECT * FROM ({any_sql(3)}) WHERE end_ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY",
)
def q_expire_matches(spark, d):
    e = events(spark, d)
    now = e.agg(F.max(ticks(e, "ts"))).scalar()
    return flat(expire_matches(match(e, pattern(A(), B(), C())), now, "3 d"))
