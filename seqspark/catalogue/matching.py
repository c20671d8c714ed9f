"""Joins and patterns: views, clicks and purchases of the same user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    compare_matches,
    count_matches,
    distinct_matches,
    format_matches,
    idle_events,
    match,
    match_aggregates,
    match_at_end,
    match_many,
    negated_matches,
    participating_events,
    route_to_queries,
)
from ..plans import next_event, prev_event, window_join
from ..plans.base import relevant_events
from ..spec import PatternSpec, Step, same_attribute
from .registry import ABC, FLAT, A, B, C, N, events, flat, pattern, query, table

D3 = "INTERVAL 3 DAY"


def any_sql(days: int, more: str = "", tables: str = ABC) -> str:
    return f"""WITH {tables}, m AS (SELECT a.user_id, a.ts AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      [a.event_id, b.event_id, c.event_id] AS l
    FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts
    JOIN c ON c.user_id = a.user_id AND c.ts > b.ts AND c.ts <= a.ts + INTERVAL {days} DAY {more}) {FLAT}"""


def next_cte(days: int) -> str:
    return f"""nc AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS c_ts FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    nb AS (SELECT *, min(CASE WHEN event_type = 'click' THEN ts END) OVER w AS b_ts FROM nc
      WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    nx AS (SELECT a.user_id, a.ts AS a_ts, a.event_id AS a_id, b.ts AS b_ts, b.event_id AS b_id,
      c.ts AS c_ts, c.event_id AS c_id
    FROM nb a JOIN nb b ON b.user_id = a.user_id AND b.ts = a.b_ts AND b.event_type = 'click'
    JOIN events c ON c.user_id = a.user_id AND c.ts = b.c_ts AND c.event_type = 'purchase'
    WHERE a.event_type = 'view' AND c.ts <= a.ts + INTERVAL {days} DAY)"""


def next_sql(days: int) -> str:
    return f"""WITH {next_cte(days)}, m AS (SELECT user_id, a_ts AS start_ts, c_ts AS end_ts, c_id AS end_id,
      [a_id, b_id, c_id] AS l FROM nx) {FLAT}"""


for days in (1, 3, 7):
    query(f"match_any_{days}d", any_sql(days))(
        lambda spark, d, days=days: flat(match(events(spark, d), pattern(A(), B(), C(), days=days)))
    )
    query(f"match_next_{days}d", next_sql(days))(
        lambda spark, d, days=days: flat(
            match(events(spark, d), pattern(A(), B(), C(), days=days, policy="next"))
        )
    )

PAIRS = f"""SELECT a.user_id, a.event_id AS l_event_id, b.event_id AS r_event_id, a.ts AS l_ts, b.ts AS r_ts
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts < b.ts AND b.ts <= a.ts + INTERVAL 1 DAY
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'"""


@query("window_join", PAIRS)
def q_window_join(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ts", "event_type")
    left, right = (e.filter(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase"))
    return window_join(left, right, "1 d", ["user_id"])


@query("window_join_salted", PAIRS)
def q_window_join_salted(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ts", "event_type")
    left, right = (e.filter(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase"))
    return window_join(left, right, "1 d", ["user_id"], salt=4)


@query(
    "next_event",
    """SELECT event_id, user_id, ts, min(CASE WHEN event_type = 'click' THEN ts END) OVER (
    PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM events""",
)
def q_next_event(spark, d):
    out = next_event(events(spark, d), "event_type = 'click'", ["user_id"])
    return out.select("event_id", "user_id", "ts", F.col("next.ts").alias("next_ts"))


@query(
    "prev_event",
    """SELECT e.event_id, e.user_id, e.ts, p.ts AS prev_ts, p.value AS prev_value FROM events e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def q_prev_event(spark, d):
    out = prev_event(events(spark, d), "event_type = 'purchase'", ["user_id"], payload=("ts", "value"))
    return out.select(
        "event_id", "user_id", "ts", F.col("prev.ts").alias("prev_ts"), F.col("prev.value").alias("prev_value")
    )


@query(
    "route_to_queries",
    """SELECT event_id, q.query_id FROM events e JOIN (VALUES ('abc', 'view'), ('abc', 'click'), ('abc', 'purchase'),
    ('bc', 'click'), ('bc', 'purchase')) q(query_id, event_type) ON e.event_type = q.event_type""",
)
def q_route(spark, d):
    specs = {"abc": pattern(A(), B(), C()), "bc": pattern(B(), C())}
    return route_to_queries(events(spark, d), specs).select("event_id", "query_id")


USED = f"""WITH {ABC}, m AS (SELECT [a.event_id, b.event_id, c.event_id] AS l
    FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts
    JOIN c ON c.user_id = a.user_id AND c.ts > b.ts AND c.ts <= a.ts + {D3}), u AS (SELECT DISTINCT unnest(l) AS id FROM m)
    SELECT event_id, user_id FROM events e WHERE """


@query("participating_events", USED + "EXISTS (SELECT 1 FROM u WHERE u.id = e.event_id)")
def q_participating(spark, d):
    e = events(spark, d)
    return participating_events(e, match(e, pattern(A(), B(), C()))).select("event_id", "user_id")


@query("idle_events", USED + "NOT EXISTS (SELECT 1 FROM u WHERE u.id = e.event_id)")
def q_idle(spark, d):
    e = events(spark, d)
    return idle_events(e, match(e, pattern(A(), B(), C()))).select("event_id", "user_id")


PREFIX = f"""WITH {ABC}, ab AS (SELECT a.user_id, a.ts AS a_ts, a.event_id AS a_id, b.ts AS b_ts, b.event_id AS b_id,
      (SELECT min(c.ts) FROM c WHERE c.user_id = a.user_id AND c.ts > b.ts) AS c_ts
    FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + {D3}),
    m AS (SELECT ab.user_id, ab.a_ts AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      list_concat([ab.a_id], (SELECT list(x.b_id ORDER BY x.b_ts) FROM ab x WHERE x.a_id = ab.a_id AND x.b_ts <= ab.b_ts),
        [c.event_id]) AS l
    FROM ab JOIN c ON c.user_id = ab.user_id AND c.ts = ab.c_ts WHERE c.ts <= ab.a_ts + {D3}) {FLAT}"""


@query("match_next_prefix", PREFIX)
def q_prefix(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C(), policy="next", mode="prefix")))


PAIR_B = f"""ac AS (SELECT a.user_id, a.ts AS a_ts, a.event_id AS a_id, c.ts AS c_ts, c.event_id AS c_id
      FROM a JOIN c ON a.user_id = c.user_id AND c.ts > a.ts AND c.ts <= a.ts + {D3}),
    abc AS (SELECT ac.*, b.ts AS b_ts, b.event_id AS b_id, b.value AS b_value FROM ac
      JOIN b ON b.user_id = ac.user_id AND b.ts > ac.a_ts AND b.ts < ac.c_ts)"""

SUBSETS = f"""WITH RECURSIVE {ABC}, {PAIR_B}, s AS (
      SELECT user_id, a_ts, a_id, c_ts, c_id, [b_id] AS bs, b_ts AS last_ts, b_value AS last_v, b_value AS total, 1 AS n
      FROM abc {{first}}
      UNION ALL SELECT s.user_id, s.a_ts, s.a_id, s.c_ts, s.c_id, list_append(s.bs, x.b_id), x.b_ts, x.b_value,
        s.total + x.b_value, s.n + 1
      FROM s JOIN abc x ON x.a_id = s.a_id AND x.c_id = s.c_id AND x.b_ts > s.last_ts {{rest}}),
    m AS (SELECT user_id, a_ts AS start_ts, c_ts AS end_ts, c_id AS end_id,
      list_concat([a_id], bs, [c_id]) AS l FROM s) {FLAT}"""


@query("match_any_all_subsets", SUBSETS.format(first="", rest=""))
def q_subsets(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C())))


@query("step_iterative_condition", SUBSETS.format(first="", rest="AND x.b_value > s.last_v"))
def q_iterative(spark, d):
    rising = B(kleene=True, iter_when=lambda cur, prev: cur["value"] > prev["value"])
    return flat(match(events(spark, d), pattern(A(), rising, C(), payload=["value"])))


@query("step_running_average", SUBSETS.format(first="", rest="AND x.b_value > s.total / s.n"))
def q_running_average(spark, d):
    above = B(kleene=True, agg_on="value", agg_when=lambda cur, acc: cur["value"] > acc["total"] / acc["n"])
    return flat(match(events(spark, d), pattern(A(), above, C(), payload=["value"])))


@query("step_first_condition", SUBSETS.format(first="WHERE b_value > 20", rest=""))
def q_first(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True, first_when="value > 20"), C())))


MAXIMAL = f"""WITH {ABC}, {PAIR_B}, m AS (SELECT user_id, a_ts AS start_ts, c_ts AS end_ts, c_id AS end_id,
      list_concat([a_id], list(b_id ORDER BY b_ts), [c_id]) AS l FROM abc GROUP BY user_id, a_ts, a_id, c_ts, c_id) {FLAT}"""


@query("match_any_maximal", MAXIMAL)
def q_maximal(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal")))


COMPACT = f"""WITH {ABC}, {PAIR_B}, g AS (SELECT user_id, a_ts, a_id, c_ts, c_id, min(b_ts) AS b1,
      list(b_id ORDER BY b_ts) AS bs FROM abc GROUP BY ALL),
    w AS (SELECT c_id, a_id, a_ts, min(a_ts) OVER (PARTITION BY c_id) AS first_a,
      lead(a_ts) OVER (PARTITION BY c_id ORDER BY a_ts) AS next_a FROM ac),
    z AS (SELECT g.*, w.next_a, (SELECT min(b.ts) FROM b WHERE b.user_id = g.user_id AND b.ts > w.first_a) AS b0
      FROM g JOIN w ON w.c_id = g.c_id AND w.a_id = g.a_id),
    m AS (SELECT user_id, a_ts AS start_ts, c_ts AS end_ts, c_id AS end_id, list_concat([a_id], bs, [c_id]) AS l
      FROM z WHERE a_ts < b0 OR next_a IS NULL OR b1 < next_a) {FLAT}"""


@query("match_any_maximal_compact", COMPACT)
def q_compact(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal_compact")))


SPLITS = f"""bw AS (SELECT c.user_id, c.ts AS c_ts, c.event_id AS c_id, b.ts AS b_ts, b.event_id AS b_id,
      lag(b.ts) OVER (PARTITION BY c.event_id ORDER BY b.ts) AS prior
      FROM c JOIN b ON b.user_id = c.user_id AND b.ts < c.ts AND b.ts >= c.ts - {D3}),
    aw AS (SELECT c.event_id AS c_id, a.ts AS a_ts, a.event_id AS a_id
      FROM c JOIN a ON a.user_id = c.user_id AND a.ts < c.ts AND a.ts >= c.ts - {D3}),
    sp AS (SELECT * FROM bw WHERE EXISTS (SELECT 1 FROM aw WHERE aw.c_id = bw.c_id AND aw.a_ts < bw.b_ts
      AND (bw.prior IS NULL OR aw.a_ts >= bw.prior))),
    sa AS (SELECT sp.c_id, sp.b_ts, min(aw.a_ts) AS start_ts, list(aw.a_id ORDER BY aw.a_ts) AS las
      FROM sp JOIN aw ON aw.c_id = sp.c_id AND aw.a_ts < sp.b_ts GROUP BY ALL),
    sb AS (SELECT sp.c_id, sp.b_ts, list(bw.b_id ORDER BY bw.b_ts) AS lbs
      FROM sp JOIN bw ON bw.c_id = sp.c_id AND bw.b_ts >= sp.b_ts GROUP BY ALL),
    full_m AS (SELECT sp.user_id, sa.start_ts, sp.c_ts AS end_ts, sp.c_id AS end_id, las[1] AS first_a, las[-1] AS split_a,
      list_concat(las, lbs, [sp.c_id]) AS l
      FROM sp JOIN sa ON sa.c_id = sp.c_id AND sa.b_ts = sp.b_ts JOIN sb ON sb.c_id = sp.c_id AND sb.b_ts = sp.b_ts)"""


@query("match_any_maximal_two_kleene", f"WITH {ABC}, {SPLITS}, m AS (SELECT * FROM full_m) {FLAT}")
def q_two_kleene(spark, d):
    return flat(match(events(spark, d), pattern(A(kleene=True), B(kleene=True), C(), mode="maximal")))


@query(
    "match_next_maximal_two_kleene",
    f"""WITH {ABC}, {SPLITS}, m AS (SELECT * FROM full_m QUALIFY row_number() OVER (
    PARTITION BY user_id, first_a, split_a ORDER BY end_ts) = 1) {FLAT}""",
)
def q_next_two_kleene(spark, d):
    spec = pattern(A(kleene=True), B(kleene=True), C(), policy="next", mode="maximal")
    return flat(match(events(spark, d), spec))


@query(
    "match_next_maximal",
    f"""WITH {next_cte(3)}, m AS (SELECT user_id, a_ts AS start_ts, c_ts AS end_ts, c_id AS end_id,
      list_concat([a_id], (SELECT list(b.event_id ORDER BY b.ts) FROM events b WHERE b.user_id = nx.user_id
        AND b.event_type = 'click' AND b.ts > a_ts AND b.ts < c_ts), [c_id]) AS l FROM nx) {FLAT}""",
)
def q_next_maximal(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C(), policy="next", mode="maximal")))


@query(
    "match_kleene_first_two_steps",
    f"""WITH {ABC}, m AS (SELECT c.user_id, min(a.ts) AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      list_append(list(a.event_id ORDER BY a.ts), c.event_id) AS l FROM c JOIN a ON a.user_id = c.user_id
      AND a.ts < c.ts AND a.ts >= c.ts - {D3} GROUP BY c.user_id, c.ts, c.event_id) {FLAT}""",
)
def q_two_steps(spark, d):
    return flat(match(events(spark, d), pattern(A(kleene=True), C(), mode="maximal")))


@query(
    "match_kleene_then_plain_steps",
    f"""WITH {ABC}, m AS (SELECT c.user_id, min(a.ts) AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      list_concat(list(a.event_id ORDER BY a.ts), [b.event_id, c.event_id]) AS l
      FROM c JOIN b ON b.user_id = c.user_id AND b.ts < c.ts AND b.ts >= c.ts - {D3}
      JOIN a ON a.user_id = c.user_id AND a.ts < b.ts AND a.ts >= c.ts - {D3}
      GROUP BY c.user_id, c.ts, c.event_id, b.event_id) {FLAT}""",
)
def q_kleene_plain(spark, d):
    return flat(match(events(spark, d), pattern(A(kleene=True), B(), C(), mode="maximal")))


@query(
    "match_four_steps_repeated_type",
    f"""WITH {ABC}, m AS (SELECT a.user_id, a.ts AS start_ts, a2.ts AS end_ts, a2.event_id AS end_id,
      [a.event_id, b.event_id, c.event_id, a2.event_id] AS l
      FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts JOIN c ON c.user_id = a.user_id AND c.ts > b.ts
      JOIN a a2 ON a2.user_id = a.user_id AND a2.ts > c.ts AND a2.ts <= a.ts + {D3}) {FLAT}""",
)
def q_four(spark, d):
    again = Step("again", "event_type = 'view'")
    return flat(match(events(spark, d), pattern(A(), B(), C(), again)))


COUNT = "SELECT CAST(count(*) AS BIGINT) AS n_matches FROM"


def number(df):
    return df.select(F.col("n_matches").cast("long").alias("n_matches"))


@query("count_any_7d", f"{COUNT} ({any_sql(7)})")
def q_count_any(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(), C(), days=7)))


@query(
    "count_any_7d_per_key",
    f"SELECT user_id, CAST(count(*) AS BIGINT) AS n_matches FROM ({any_sql(7)}) GROUP BY user_id",
)
def q_count_any_key(spark, d):
    out = count_matches(events(spark, d), pattern(A(), B(), C(), days=7), per_key=True)
    return out.filter("n_matches > 0").select("user_id", F.col("n_matches").cast("long").alias("n_matches"))


@query("count_any_maximal", f"{COUNT} ({MAXIMAL})")
def q_count_maximal(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal")))


@query(
    "count_any_all_subsets",
    f"""WITH {ABC}, {PAIR_B}, g AS (SELECT a_id, c_id, count(*) AS k FROM abc GROUP BY ALL)
    SELECT CAST(sum(pow(2, k) - 1) AS BIGINT) AS n_matches FROM g""",
)
def q_count_subsets(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(kleene=True), C())))


@query("count_next", f"{COUNT} ({next_sql(3)})")
def q_count_next(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(), C(), policy="next")))


@query("count_compact", f"{COUNT} ({COMPACT})")
def q_count_compact(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal_compact")))


@query("count_two_kleene", f"{COUNT} (WITH {ABC}, {SPLITS}, m AS (SELECT * FROM full_m) {FLAT})")
def q_count_two_kleene(spark, d):
    return number(count_matches(events(spark, d), pattern(A(kleene=True), B(kleene=True), C(), mode="maximal")))


@query("count_next_prefix", f"{COUNT} ({PREFIX})")
def q_count_prefix(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), B(kleene=True), C(), policy="next", mode="prefix")))


@query(
    "match_contiguous",
    f"""WITH l AS (SELECT *, lead(event_type) OVER w AS t1, lead(event_id) OVER w AS i1,
      lead(event_type, 2) OVER w AS t2, lead(event_id, 2) OVER w AS i2, lead(ts, 2) OVER w AS e FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, ts AS start_ts, e AS end_ts, i2 AS end_id, [event_id, i1, i2] AS l FROM l
      WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND e <= ts + {D3}) {FLAT}""",
)
def q_contiguous(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(), C(), policy="contiguous")))


@query(
    "match_contiguous_kleene",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    stop AS (SELECT o.*, min(CASE WHEN event_type <> 'click' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_pos FROM o),
    m AS (SELECT a.user_id, a.ts AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      list_concat([a.event_id], (SELECT list(b.event_id ORDER BY b.pos) FROM o b WHERE b.user_id = a.user_id
        AND b.pos > a.pos AND b.pos < c.pos), [c.event_id]) AS l
      FROM stop a JOIN o c ON c.user_id = a.user_id AND c.pos = a.stop_pos AND c.event_type = 'purchase'
      WHERE a.event_type = 'view' AND a.stop_pos > a.pos + 1 AND c.ts <= a.ts + {D3}) {FLAT}""",
)
def q_contiguous_kleene(spark, d):
    return flat(match(events(spark, d), pattern(A(), B(kleene=True), C(), policy="contiguous")))


NEG = f"""WITH {ABC}, m AS (SELECT a.user_id, a.ts AS start_ts, c.ts AS end_ts, c.event_id AS end_id,
      [a.event_id, c.event_id] AS l FROM a JOIN c ON a.user_id = c.user_id AND c.ts > a.ts AND c.ts <= a.ts + {D3}
      WHERE {{no}} EXISTS (SELECT 1 FROM events n WHERE n.user_id = a.user_id AND n.event_type = 'error'
        AND n.ts BETWEEN a.ts AND c.ts)) {FLAT}"""


@query("match_negation", NEG.format(no="NOT"))
def q_negation(spark, d):
    return flat(match(events(spark, d), pattern(A(), N(), C())))


@query("count_negation", f"{COUNT} ({NEG.format(no='NOT')})")
def q_count_negation(spark, d):
    return number(count_matches(events(spark, d), pattern(A(), N(), C())))


@query("negated_matches", NEG.format(no=""))
def q_negated(spark, d):
    return flat(negated_matches(events(spark, d), pattern(A(), N(), C())))


ORDERS = """SELECT o_custkey, start_ts, end_ts, end_id, CAST(2 AS BIGINT) AS n_events, ids FROM (
    SELECT a.o_custkey, a.o_orderdate AS start_ts, c.o_orderdate AS end_ts, c.o_orderkey AS end_id,
      CAST(a.o_orderkey AS VARCHAR) || ',' || CAST(c.o_orderkey AS VARCHAR) AS ids
    FROM orders a JOIN orders c ON a.o_custkey = c.o_custkey AND c.o_orderdate > a.o_orderdate
      AND c.o_orderdate <= a.o_orderdate + INTERVAL 90 DAY
    WHERE a.o_orderpriority = '5-LOW' AND c.o_orderpriority = '1-URGENT')"""


@query("partition_by_customer_orders", ORDERS)
def q_orders(spark, d):
    steps = [Step("low", "o_orderpriority = '5-LOW'"), Step("urgent", "o_orderpriority = '1-URGENT'")]
    spec = PatternSpec(steps, within="90 d", partition_by=["o_custkey"], ts="o_orderdate", id="o_orderkey")
    m = match(table(spark, d, "orders"), spec)
    joined = F.concat_ws(",", F.transform("event_ids", lambda e: e.cast("string")))
    return m.select("o_custkey", "start_ts", "end_ts", "end_id", F.col("n_events").cast("long"), joined.alias("ids"))


@query("match_unpartitioned_1h", f"""WITH {ABC}, m AS (SELECT a.user_id, a.ts AS start_ts, c.ts AS end_ts,
      c.event_id AS end_id, [a.event_id, b.event_id, c.event_id] AS l FROM a JOIN b ON b.ts > a.ts
      JOIN c ON c.ts > b.ts AND c.ts <= a.ts + INTERVAL 1 HOUR WHERE b.ts <= a.ts + INTERVAL 1 HOUR)
      SELECT start_ts, end_ts, end_id, CAST(len(l) AS BIGINT) AS n_events FROM m""")
def q_unpartitioned(spark, d):
    m = match(events(spark, d), PatternSpec([A(), B(), C()], within="1 h"))
    return m.select("start_ts", "end_ts", "end_id", F.col("n_events").cast("long").alias("n_events"))


AT_END = "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50"


@query("match_at_end", f"SELECT * FROM ({any_sql(3)}) WHERE end_id IN ({AT_END})")
def q_at_end(spark, d):
    e = events(spark, d)
    ends = e.filter("event_type = 'purchase' AND value > 50").select(F.col("event_id").alias("end_id"))
    return flat(match_at_end(e, pattern(A(), B(), C()), ends))


@query("match_at_end_next", f"SELECT * FROM ({next_sql(3)}) WHERE end_id IN ({AT_END})")
def q_at_end_next(spark, d):
    e = events(spark, d)
    ends = e.filter("event_type = 'purchase' AND value > 50").select(F.col("event_id").alias("end_id"))
    return flat(match_at_end(e, pattern(A(), B(), C(), policy="next"), ends))


@query(
    "match_many",
    f"""SELECT 'any' AS query_id, * FROM ({any_sql(1)}) UNION ALL SELECT 'next', * FROM ({next_sql(3)})
    UNION ALL SELECT 'maximal', * FROM ({MAXIMAL})""",
)
def q_many(spark, d):
    specs = {
        "any": pattern(A(), B(), C(), days=1),
        "next": pattern(A(), B(), C(), policy="next"),
        "maximal": pattern(A(), B(kleene=True), C(), mode="maximal"),
    }
    return flat(match_many(events(spark, d), specs), "query_id")


@query(
    "format_matches",
    f"""SELECT end_id, 'e' || replace(ids, ',', ' e') || ' [' || strftime(start_ts, '%Y-%m-%d %H:%M:%S') || ' - '
    || strftime(end_ts, '%Y-%m-%d %H:%M:%S') || ']' AS line FROM ({next_sql(3)})""",
)
def q_format(spark, d):
    m = match(events(spark, d), pattern(A(), B(), C(), policy="next"))
    whole = m.withColumns({c: F.date_trunc("second", c) for c in ("start_ts", "end_ts")})
    return format_matches(whole, "e{id}").select("end_id", "line")


@query("relevant_events", "SELECT * FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def q_relevant(spark, d):
    return relevant_events(events(spark, d), pattern(A(), B(), C()))


@query(
    "step_arithmetic_condition",
    any_sql(3, "AND (c.value * 2 + 10) % 100 > 50 AND (b.value < 10 OR (b.value > 30 AND b.user_id % 2 = 0))"),
)
def q_arithmetic(spark, d):
    b = Step("b", (F.col("event_type") == "click") & ((F.col("value") < 10) | ((F.col("value") > 30) & (F.col("user_id") % 2 == 0))))
    c = Step("c", "event_type = 'purchase' AND (value * 2 + 10) % 100 > 50")
    return flat(match(events(spark, d), pattern(A(), b, c)))


@query("step_cross_condition", any_sql(3, "AND c.value > a.value AND b.value < a.value"))
def q_cross(spark, d):
    b = B(cross_when=lambda cur, bound: cur["value"] < bound["a"]["value"])
    c = C(cross_when=lambda cur, bound: cur["value"] > bound["a"]["value"])
    return flat(match(events(spark, d), pattern(A(), b, c, payload=["value"])))


@query(
    "step_cross_condition_next",
    f"""WITH {ABC}, ab AS (SELECT a.user_id, a.ts AS a_ts, a.event_id AS a_id, a.value AS a_v,
      min(b.ts) AS b_ts, arg_min(b.event_id, b.ts) AS b_id
      FROM a JOIN b ON b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + {D3} AND b.value < a.value GROUP BY ALL),
    m AS (SELECT ab.user_id, a_ts AS start_ts, min(c.ts) AS end_ts, arg_min(c.event_id, c.ts) AS end_id,
      [a_id, b_id, arg_min(c.event_id, c.ts)] AS l
      FROM ab JOIN c ON c.user_id = ab.user_id AND c.ts > b_ts AND c.ts <= a_ts + {D3} GROUP BY ab.user_id, a_ts, a_id, b_id) {FLAT}""",
)
def q_cross_next(spark, d):
    b = B(cross_when=lambda cur, bound: cur["value"] < bound["a"]["value"])
    return flat(match(events(spark, d), pattern(A(), b, C(), payload=["value"], policy="next")))


K3 = "CAST(json_extract(props, '$.k') AS BIGINT) % 3"


@query(
    "same_attribute",
    any_sql(7, "AND a.k3 = b.k3 AND b.k3 = c.k3", ABC.replace("SELECT *", f"SELECT *, {K3} AS k3")),
)
def q_same(spark, d):
    e = events(spark, d).withColumn("k3", F.get_json_object("props", "$.k").cast("long") % 3)
    return flat(match(e, same_attribute(pattern(A(), B(), C(), days=7), "k3")))


@query(
    "match_aggregates",
    f"""WITH {ABC}, {PAIR_B} SELECT a_id, c_id, min(b_value) AS value_min, max(b_value) AS value_max,
    round(sum(b_value), 6) AS value_sum, round(avg(b_value), 6) AS value_avg, count(*) AS value_count,
    arg_max(b_value, b_ts) AS value_last FROM abc GROUP BY a_id, c_id""",
)
def q_aggregates(spark, d):
    m = match(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal", payload=["value"]))
    return match_aggregates(m, "b", "value").select(
        F.col("a.id").alias("a_id"), F.col("end_id").alias("c_id"), "value_min", "value_max",
        F.round("value_sum", 6).alias("value_sum"), F.round("value_avg", 6).alias("value_avg"),
        F.col("value_count").cast("long").alias("value_count"), "value_last",
    )


@query("distinct_matches", MAXIMAL)
def q_distinct(spark, d):
    m = match(events(spark, d), pattern(A(), B(kleene=True), C(), mode="maximal"))
    return flat(distinct_matches(m.unionByName(m)))


@query(
    "compare_matches",
    f"""WITH f AS (SELECT user_id, ids FROM ({any_sql(3)})), t AS (SELECT user_id, ids FROM ({next_sql(7)})),
    j AS (SELECT coalesce(f.user_id, t.user_id) AS user_id, f.ids AS fi, t.ids AS ti FROM f FULL JOIN t
      ON f.user_id = t.user_id AND f.ids = t.ids)
    SELECT user_id, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (
      SELECT user_id, count(*) FILTER (fi IS NOT NULL AND ti IS NOT NULL) AS tp, count(*) FILTER (ti IS NULL) AS fp,
      count(*) FILTER (fi IS NULL) AS fn FROM j GROUP BY user_id)""",
)
def q_compare(spark, d):
    e = events(spark, d)
    found = match(e, pattern(A(), B(), C()))
    truth = match(e, pattern(A(), B(), C(), days=7, policy="next"))
    return compare_matches(found, truth, ["user_id"])
