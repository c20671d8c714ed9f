"""Matches while events arrive in portions: when they stand, how they were published, how right they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    accuracy_under_disorder,
    first_last_per_end,
    match_lifetimes,
    match_provenance,
    match_stats,
    match_status,
    negated_matches,
    portion_changelog,
)
from .late import LATE, classified
from .matching import COMPACT, MAXIMAL, NEG, any_sql, next_sql
from .registry import A, B, C, N, arrivals, events, flat, ids, pattern, query, scratch, written
from .streams import LEVELS, disorder

PORTIONS = 3


def in_portions(spark, d):
    """Arrivals in three portions of equal size, as a table: lifetimes read it several times."""
    e = arrivals(spark, d)
    size = events(spark, d).agg((F.count(F.lit(1)) / PORTIONS).cast("long") + 1).scalar()
    return written(spark, e.withColumn("portion", F.floor((F.col("arrival_seq") - 1) / size)))


def at_levels(sql: str, more: str = "") -> str:
    """CTEs ending in ``lv``: the rows of ``sql`` over the events of portions 0..n, for every portion n (``lvl``)."""
    levels = []
    for n in range(PORTIONS):
        seen = f"(SELECT * FROM cut WHERE part <= {n})"
        levels.append(f"SELECT {n} AS lvl, * FROM ({sql.replace('FROM events', 'FROM ' + seen).replace('JOIN events', 'JOIN ' + seen)})")
    return f"""{LATE}, cut AS (SELECT *, (arrival_seq - 1) // (SELECT count(*) // {PORTIONS} + 1 FROM arr) AS part FROM st),
    lv AS ({" UNION ALL ".join(levels)}){more}"""


def lifetimes_sql(sql: str) -> str:
    return f"""WITH {at_levels(sql)} SELECT user_id, start_ts, end_ts, end_id, n_events, ids, min(lvl)::BIGINT AS born,
    CASE WHEN max(lvl) < {PORTIONS - 1} THEN max(lvl) ELSE -1 END::BIGINT AS last FROM lv GROUP BY ALL"""


SHAPES = {
    "any_compact": (COMPACT, lambda: pattern(A(), B(kleene=True), C(), mode="maximal_compact")),
    "next": (next_sql(3), lambda: pattern(A(), B(), C(), policy="next")),
    "negation": (NEG.format(no="NOT"), lambda: pattern(A(), N(), C())),
}
for name, (sql, spec) in SHAPES.items():

    @query(f"match_lifetimes_{name}", lifetimes_sql(sql))
    def q_lifetimes(spark, d, spec=spec):
        out = match_lifetimes(in_portions(spark, d), spec())
        return flat(out, "born", F.coalesce("last", F.lit(-1)).cast("long").alias("last"))


# the last arrival of every match and whether it was late
ARRIVED = f"""WITH {LATE}, m AS ({MAXIMAL}), e AS (SELECT ids, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS event_id FROM m),
p AS (SELECT ids, max(arrival_seq) AS arrived, arg_max(status = 'late', arrival_seq) AS is_ooo FROM e JOIN st USING (event_id) GROUP BY ids),
late AS (SELECT m.*, arrived, is_ooo FROM m JOIN p USING (ids))"""


def maximal():
    return pattern(A(), B(kleene=True), C(), mode="maximal")


@query("match_provenance", f"{ARRIVED} SELECT * FROM late")
def q_provenance(spark, d):
    m = match_provenance(classified(spark, d), maximal())
    return flat(m, F.col("arrived").cast("long").alias("arrived"), "is_ooo")


@query(
    "match_stats",
    f"""{ARRIVED} SELECT x.user_id, x.matches, x.late_matches, x.longest, coalesce(n.negated_matches, 0) AS negated_matches FROM (
    SELECT user_id, count(*) AS matches, count(*) FILTER (is_ooo) AS late_matches, max(n_events) AS longest FROM late GROUP BY user_id) x
    LEFT JOIN (SELECT user_id, count(*) AS negated_matches FROM ({NEG.format(no="")}) GROUP BY user_id) n
    ON n.user_id = x.user_id""",
)
def q_match_stats(spark, d):
    m = match_provenance(classified(spark, d), maximal())
    out = match_stats(m, ["user_id"], negated_matches(events(spark, d), pattern(A(), N(), C())))
    return out.filter("matches > 0").withColumn("longest", F.col("longest").cast("long"))


@query(
    "match_status",
    f"""WITH {at_levels(MAXIMAL)}, life AS (SELECT user_id, end_id, ids, n_events, min(lvl) AS born, max(lvl) AS last FROM lv GROUP BY ALL),
    e AS (SELECT ids, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS event_id FROM life),
    p AS (SELECT ids, arg_max(status = 'late', arrival_seq) AS is_ooo FROM e JOIN st USING (event_id) GROUP BY ids)
    SELECT user_id, end_id, n_events, ids,
      CASE WHEN born > min(born) OVER (PARTITION BY end_id, string_split(ids, ',')[1]) THEN 'updated' WHEN is_ooo THEN 'late' ELSE 'emitted' END AS status,
      born::BIGINT AS emitted_at, CASE WHEN last < {PORTIONS - 1} THEN last + 1 ELSE -1 END::BIGINT AS gone_at
    FROM life JOIN p USING (ids)""",
)
def q_match_status(spark, d):
    """How the matches of three portions were published; the late bit comes from the classified arrivals."""
    spec, cut = maximal(), in_portions(spark, d)
    life = written(spark, match_lifetimes(cut, spec))
    late = classified(spark, d).select("event_id", "is_late")
    # every version that ever stood, over the events up to its last portion, is a match of some portion
    versions = life.select("user_id", "end_id", "match_id", F.explode("event_ids").alias("event_id"))
    bits = versions.join(cut.select("event_id", "arrival_seq"), "event_id").join(late, "event_id")
    bits = bits.groupBy("user_id", "end_id", "match_id").agg(F.max_by("is_late", "arrival_seq").alias("is_ooo"))
    out = match_status(written(spark, portion_changelog(life, spec)), spec.keys, bits)
    return out.select(
        "user_id", "end_id", F.col("n_events").cast("long").alias("n_events"), ids(), "status", F.col("emitted_at").cast("long").alias("emitted_at"),
        F.coalesce("gone_at", F.lit(-1)).cast("long").alias("gone_at"),
    )


def corrected_sql() -> str:
    """Once corrections are applied, what stands after the last portion against the final matches."""
    sides = {"any": any_sql(1), "next": next_sql(1)}
    parts = []
    for p in LEVELS:
        arrived = f"({disorder(p, 0)})"
        for name, sql in sides.items():
            last = sql.replace("FROM events", f"FROM {arrived}").replace("JOIN events", f"JOIN {arrived}")
            parts.append(
                f"""SELECT {p}::DOUBLE AS prob, '{name}' AS query_id, count(*) FILTER (f.ids IS NOT NULL AND t.ids IS NOT NULL) AS tp,
                count(*) FILTER (t.ids IS NULL) AS fp, count(*) FILTER (f.ids IS NULL) AS fn
                FROM (SELECT DISTINCT ids FROM ({last})) f FULL JOIN (SELECT DISTINCT ids FROM ({sql})) t ON f.ids = t.ids"""
            )
    return f"SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM ({' UNION ALL '.join(parts)})"


@query("accuracy_corrected", corrected_sql())
def q_accuracy_corrected(spark, d):
    specs = {"any": pattern(A(), B(), C(), days=1), "next": pattern(A(), B(), C(), days=1, policy="next")}
    e = events(spark, d)
    portion = e.agg((F.count(F.lit(1)) / 3).cast("long")).scalar()
    return accuracy_under_disorder(e, specs, LEVELS, rounds=3, rows_per_round=portion, with_correction=True, store=scratch(spark))


@query(
    "first_last_per_end",
    """WITH c AS (SELECT user_id, ts AS end_ts, event_id AS end_id FROM events WHERE event_type = 'purchase')
    SELECT c.user_id, c.end_ts, c.end_id, coalesce(arg_min(e.event_id, e.ts) FILTER (e.event_type = 'view'), -1) AS first_a,
      coalesce(arg_max(e.event_id, e.ts) FILTER (e.event_type = 'view'), -1) AS last_a,
      coalesce(arg_min(e.event_id, e.ts) FILTER (e.event_type = 'click'), -1) AS first_b,
      coalesce(arg_max(e.event_id, e.ts) FILTER (e.event_type = 'click'), -1) AS last_b
    FROM c LEFT JOIN events e ON e.user_id = c.user_id AND e.ts >= c.end_ts - INTERVAL 3 DAY AND e.ts < c.end_ts GROUP BY ALL""",
)
def q_first_last_per_end(spark, d):
    out = first_last_per_end(events(spark, d), pattern(A(), B(), C()))
    names = ["first_a", "last_a", "first_b", "last_b"]
    return out.select("user_id", "end_ts", "end_id", *[F.coalesce(F.col(n)["id"], F.lit(-1)).alias(n) for n in names])
