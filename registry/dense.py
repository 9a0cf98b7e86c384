"""Choices among thousands of rows an hour, where every rule of the pool leaves rows out.

Most journeys stop at one station, with several rows there, and stations differ in how good their rows are; one journey of each horizon has a good row at
every station, the best where the others are best too, which is a trap for choices row by row. The exact choice is then
found in SQL by a dynamic programme over stations and counts, once for each place that the one journey can take.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from delaymill.config import EXACT, GREEDY, RANDOM, SCORE_FIRST, SOLVED, STOPPED
from delaymill.operators import candidates as cand
from delaymill.operators import outcomes as out
from delaymill.operators import policies as pol
from delaymill.sources.sample_feed import load_events
from registry.common import printed, query
from registry.selection import CAPACITIES, POLICY, STOPPED_AT_ONCE, recursive

STATIONS, JOURNEYS, EVERYWHERE = 30, 60, 97
MOST = max(CAPACITIES)


def dense_candidates(spark, folder):
    """Three crowded horizons made of all events."""
    events = load_events(spark, folder)
    at, number = F.col("event_id") % STATIONS, F.expr(f"event_id div {STATIONS}")
    roams = number % EVERYWHERE == 0
    usual = (0.5 + 0.45 * ((F.col("event_id") * 7919) % 9973) / 9973) * (1 - at / 100)
    good = 0.95 + 0.04 * (STATIONS - at) / STATIONS + 0.005 * ((F.col("event_id") * 104729) % 9967) / 9967
    return events.select(
        F.lit("final").alias("execution_mode"),
        F.concat(F.lit("crowd "), (F.hour("ts") % 3).cast("string")).alias("horizon_id"),
        F.lit(True).alias("is_eligible_candidate"),
        F.col("event_id").cast("string").alias("stop_event_key"),
        F.when(roams, F.lit("everywhere")).otherwise(F.concat_ws("-", at.cast("string"), (number % JOURNEYS).cast("string"))).alias("journey_id"),
        F.concat(F.lit("S"), at.cast("string")).alias("station_id"),
        F.when(roams, good).otherwise(usual).alias(cand.PROBABILITY),
        (F.col("event_id") % 4 == 0).alias(cand.OUTCOME),
    )


_ROWS = f"""open_rows AS (
  SELECT 'crowd ' || hour(ts) % 3 AS h, CAST(event_id AS VARCHAR) AS k, event_id % {STATIONS} AS s,
         CASE WHEN (event_id // {STATIONS}) % {EVERYWHERE} = 0 THEN 'everywhere'
              ELSE event_id % {STATIONS} || '-' || (event_id // {STATIONS}) % {JOURNEYS} END AS j,
         CASE WHEN (event_id // {STATIONS}) % {EVERYWHERE} = 0
              THEN 0.95::DOUBLE + 0.04::DOUBLE * ({STATIONS} - event_id % {STATIONS})::DOUBLE / {STATIONS} + 0.005::DOUBLE * ((event_id * 104729) % 9967)::DOUBLE / 9967
              ELSE (0.5::DOUBLE + 0.45::DOUBLE * ((event_id * 7919) % 9973)::DOUBLE / 9973) * (1 - (event_id % {STATIONS})::DOUBLE / 100) END AS p FROM events),
caps AS (SELECT unnest({list(CAPACITIES)}) AS c)"""
_WALKS = f"""walk_score AS (
  SELECT h, k, row_number() OVER (PARTITION BY h ORDER BY p DESC, k) AS turn
  FROM (SELECT * FROM open_rows QUALIFY row_number() OVER (PARTITION BY h, j ORDER BY p DESC, k) = 1)),
walk_random AS (
  SELECT h, k, row_number() OVER (PARTITION BY h ORDER BY draw, k) AS turn
  FROM (SELECT *, sha256('17|' || h || '|' || k) AS draw FROM open_rows QUALIFY row_number() OVER (PARTITION BY h, j ORDER BY draw, k) = 1)),
walk_greedy AS (
  SELECT h, 0 AS turn, CAST([] AS VARCHAR[]) AS js, CAST([] AS BIGINT[]) AS ss, CAST(NULL AS VARCHAR) AS k FROM (SELECT DISTINCT h FROM open_rows)
  UNION ALL
  SELECT g.h, g.turn + 1, list_append(g.js, e.j), list_append(g.ss, e.s), e.k
  FROM walk_greedy g JOIN open_rows e ON e.h = g.h WHERE g.turn < {MOST} AND NOT list_contains(g.js, e.j)
  QUALIFY row_number() OVER (PARTITION BY g.h ORDER BY e.p - CASE WHEN list_contains(g.ss, e.s) THEN 0.2::DOUBLE ELSE 0::DOUBLE END DESC, e.p DESC, e.k) = 1),
chosen AS (
  SELECT '{SCORE_FIRST}' AS policy, c, h, k FROM walk_score, caps WHERE turn <= c
  UNION ALL SELECT '{RANDOM}', c, h, k FROM walk_random, caps WHERE turn <= c
  UNION ALL SELECT '{GREEDY}', c, h, k FROM walk_greedy, caps WHERE turn BETWEEN 1 AND c),
loads AS (SELECT policy, c, h, s, count(*) AS n, sum(p) AS total, list(k) AS ks FROM chosen JOIN open_rows USING (h, k) GROUP BY ALL),
walked AS (
  SELECT h, policy, c, sum(n) AS n, sum(total) - 0.2 * sum(n - 1) AS worth, sha256(array_to_string(list_sort(flatten(list(ks))), '|')) AS keys
  FROM loads GROUP BY ALL)"""
# gain of m rows at a station: its m best journeys less the penalty; with the one journey there, that and the m - 1 best others
_PROGRAMME = f"""best_rows AS (SELECT h, s, j, max(p) AS p FROM open_rows GROUP BY ALL),
own AS (SELECT h, s, list(p ORDER BY p DESC)[1:{MOST}] AS ps FROM best_rows WHERE j <> 'everywhere' GROUP BY ALL),
places AS (SELECT h, s AS w, p FROM best_rows WHERE j = 'everywhere' UNION ALL SELECT DISTINCT h, -1, CAST(NULL AS DOUBLE) FROM open_rows),
gains AS (
  SELECT o.h, w, row_number() OVER (PARTITION BY o.h, w ORDER BY s) AS turn,
         list_transform(range(0, {MOST} + 1), lambda m: CASE
           WHEN w <> s AND m > len(ps) OR w = s AND (m = 0 OR m - 1 > len(ps)) THEN NULL
           WHEN w = s THEN l.p + coalesce(list_sum(ps[1:m - 1]), 0) - 0.2 * greatest(m - 1, 0)
           ELSE coalesce(list_sum(ps[1:m]), 0) - 0.2 * greatest(m - 1, 0) END) AS g
  FROM own o JOIN places l ON l.h = o.h),
programme AS (
  SELECT h, w, 0 AS turn, list_transform(range(0, {MOST} + 1), lambda m: CASE WHEN m = 0 THEN 0::DOUBLE END) AS best FROM places
  UNION ALL
  SELECT p.h, p.w, p.turn + 1, list_transform(range(0, {MOST} + 1), lambda k: list_max(list_transform(range(0, k + 1), lambda m: p.best[k - m + 1] + q.g[m + 1])))
  FROM programme p JOIN gains q ON q.h = p.h AND q.w = p.w AND q.turn = p.turn + 1),
optimum AS (
  SELECT h, c, max(best[c + 1]) AS worth FROM programme, caps WHERE turn = (SELECT max(turn) FROM gains) GROUP BY ALL)"""


@query(
    "dense_policy_choices",
    recursive(
        _ROWS,
        _WALKS,
        _PROGRAMME,
        final=printed(
            f"""SELECT h AS horizon_id, policy AS policy_name, c AS capacity_per_hour, CAST(n AS BIGINT) AS selected_event_count, worth,
            keys AS selected_keys_hash, 'deterministic' AS solver_status FROM walked
            UNION ALL SELECT h, '{EXACT}', c, c, worth, NULL, '{SOLVED}' FROM optimum""",
            doubles="worth",
        ),
    ),
)
def dense_policy_choices(spark, folder):
    """What each policy chooses from crowded horizons. Of equally good exact choices SQL finds the worth alone, hence no hash of their keys."""
    chosen = pol.choices(dense_candidates(spark, folder), POLICY)
    rows = chosen.withColumns(out.pick_statistics(F.col("picks"), F.lit(POLICY.preferred_station_load)))
    exact = F.col("policy_name") == EXACT
    return rows.select(
        "horizon_id", "policy_name", "capacity_per_hour", "selected_event_count",
        (F.col("selected_probability_score_sum") - POLICY.station_penalty * F.col("station_concentration_excess_total")).alias("worth"),
        F.when(~exact, out.key_set_hash(F.col("selected_keys"))).alias("selected_keys_hash"),
        "solver_status",
    )


@query(
    "disallowed_statuses",
    recursive(
        _ROWS,
        _WALKS,
        _PROGRAMME,
        final=f"""SELECT 'final' AS execution_mode, '{STOPPED}' AS solver_status, count(*) AS choice_count
        FROM optimum o JOIN walked w ON w.h = o.h AND w.c = o.c AND w.policy = '{GREEDY}' WHERE o.worth - w.worth > 1e-9 HAVING count(*) > 0""",
    ),
)
def disallowed_statuses(spark, folder):
    """A run whose search is stopped at once: it takes row by row, and only where that is the optimum do the dual values prove it."""
    chosen = pol.choices(dense_candidates(spark, folder), STOPPED_AT_ONCE, names=(EXACT,))
    return out.disallowed_statuses(chosen, STOPPED_AT_ONCE)


_RULES = [("h, j, s", 1), ("h, s", MOST), ("h, j", MOST), ("h", 2 * MOST * (MOST - 1) + 1)]
_STEPS = ",\n".join(
    f"rule_{i} AS (SELECT * FROM {'open_rows' if i == 1 else f'rule_{i - 1}'} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY p DESC, k) <= {n})"
    for i, (group, n) in enumerate(_RULES, 1)
)


@query(
    "pool_rules",
    recursive(
        _ROWS,
        _STEPS,
        final=" UNION ALL ".join(
            f"SELECT h AS horizon_id, {i} AS rule, count(*) AS rows_left FROM {'open_rows' if i == 0 else f'rule_{i}'} GROUP BY h"
            for i in range(5)
        ),
    ),
)
def pool_rules(spark, folder):
    """Rows of the crowded horizons that are left after each rule of the pool."""
    steps = pol.pool_steps(dense_candidates(spark, folder), MOST)
    counted = [s.groupBy("horizon_id").agg(F.count(F.lit(1)).alias("rows_left")).withColumn("rule", F.lit(i)) for i, s in enumerate(steps)]
    return reduce(lambda a, b: a.unionByName(b), counted)
