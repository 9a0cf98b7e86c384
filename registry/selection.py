"""Candidates, selection policies and what they achieve."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from delaymill.config import EXACT, GREEDY, RANDOM, SCORE_FIRST, SOLVED, SPLIT_OF_MODE, STOPPED, Policy
from delaymill.operators import candidates as cand
from delaymill.operators import outcomes as out
from delaymill.operators import policies as pol
from delaymill.session import spool
from delaymill.sources.sample_feed import held_out_scores, load_events
from registry.common import printed, query, stops_cte, with_ctes
from registry.evaluation import SCORES

TEST_FROM = "2024-01-16"
MODEL = ("logistic_regression", "2026-06-28-v1")
POLICY = Policy(
    selected_threshold=0.5,
    scoring_model_name=MODEL[0],
    scoring_model_version=MODEL[1],
    preferred_station_load=1,
    station_penalty=0.2,
    run_id="r1",
    optimized_at="2024-02-02T00:00:00+00:00",
    frozen_at="2024-02-01T12:00:00+00:00",
)
CAPACITIES = POLICY.search.scenario_capacities
CANONICAL = POLICY.search.canonical_tuning_capacity_per_hour

# ---- SQL: every policy found by brute force on the eligible rows ---------------------------------

_CANDIDATES = f"""cand AS (
  SELECT s.id AS stop_event_key, s.train_line_ride_id AS journey_id, CAST(s.time AS DATE) AS service_date,
         s.eva AS station_id, CASE WHEN CAST(s.id AS BIGINT) % 17 = 0 THEN NULL ELSE s.station_name END AS station_name,
         s.train_type, s.line_number,
         s.train_type || '-' || s.train_number || '-' || coalesce(s.line_number, 'none') AS train_service_key,
         CASE WHEN s.train_type IN ('ICE', 'IC') THEN 'long_distance' WHEN s.train_type = 'RE' THEN 'regional'
              WHEN s.train_type = 'S' THEN 'local_urban' ELSE 'other' END AS service_class,
         CASE WHEN s.time >= DATE '{TEST_FROM}' THEN 'test' ELSE 'validation' END AS prediction_split,
         CASE WHEN s.time >= DATE '{TEST_FROM}' THEN 'final' ELSE 'development' END AS execution_mode,
         CAST(hour(s.time) AS INTEGER) AS hour_of_day, strftime(s.time, '%Y-%m-%d') AS calendar_date,
         strftime(s.time, '%Y-%m-%d') || '|' || hour(s.time) AS horizon_id, x.predicted_probability AS p,
         date_diff('minute', s.departure_planned_time, s.departure_change_time) >= 15 AS severe,
         CASE WHEN p IS NULL OR p < 0 OR p > 1 THEN 'invalid_probability'
              WHEN p < 0.5 THEN 'below_minimum_candidate_probability' ELSE 'eligible' END AS eligibility_reason
  FROM stops s JOIN scores x ON x.stop_event_key = s.id
  WHERE s.departure_planned_time IS NOT NULL AND NOT s.is_canceled),
open_rows AS (
  SELECT execution_mode AS mode, horizon_id AS h, stop_event_key AS k, journey_id AS j, station_id AS s, p, severe,
         CAST(row_number() OVER (PARTITION BY execution_mode, horizon_id ORDER BY p DESC, stop_event_key) AS INTEGER) AS i
  FROM cand WHERE eligibility_reason = 'eligible'),
horizons AS (
  SELECT execution_mode AS mode, horizon_id AS h, any_value(calendar_date) AS calendar_date,
         any_value(hour_of_day) AS hour_of_day, count(*) AS candidate_count,
         count(*) FILTER (WHERE eligibility_reason = 'eligible') AS eligible_candidate_count,
         count(*) FILTER (WHERE eligibility_reason = 'eligible' AND severe) AS actual_severe_candidate_count,
         count(DISTINCT journey_id) FILTER (WHERE eligibility_reason = 'eligible') AS journeys
  FROM cand GROUP BY 1, 2),
caps AS (SELECT unnest([1, 3, 5, 10]) AS c)"""

_SCORE_FIRST = """walk_score AS (
  SELECT mode, h, k, CAST(row_number() OVER (PARTITION BY mode, h ORDER BY i) AS INTEGER) AS turn
  FROM (SELECT * FROM open_rows QUALIFY row_number() OVER (PARTITION BY mode, h, j ORDER BY i) = 1)),
walk_random AS (
  SELECT mode, h, k, CAST(row_number() OVER (PARTITION BY mode, h ORDER BY draw, k) AS INTEGER) AS turn
  FROM (SELECT *, sha256('17|' || h || '|' || k) AS draw FROM open_rows
        QUALIFY row_number() OVER (PARTITION BY mode, h, j ORDER BY draw, k) = 1))"""

_GREEDY = """walk_greedy AS (
  SELECT mode, h, 0 AS turn, CAST([] AS VARCHAR[]) AS js, CAST([] AS VARCHAR[]) AS ss, CAST(NULL AS VARCHAR) AS k
  FROM horizons
  UNION ALL
  SELECT g.mode, g.h, g.turn + 1, list_append(g.js, e.j), list_append(g.ss, e.s), e.k
  FROM walk_greedy g JOIN open_rows e ON e.mode = g.mode AND e.h = g.h
  WHERE g.turn < 10 AND NOT list_contains(g.js, e.j)
  QUALIFY row_number() OVER (PARTITION BY g.mode, g.h
    ORDER BY e.p - CASE WHEN list_contains(g.ss, e.s) THEN 0.2 ELSE 0.0 END DESC, e.i) = 1)"""


def _subsets(loads: str, penalties: str, most: int) -> str:
    """All sets of eligible rows with one row per journey, and their objective in integers."""
    return f"""points AS (SELECT * FROM (SELECT unnest({loads}) AS load),
      (SELECT unnest({penalties}) AS penalty)),
subsets AS (
  SELECT mode, h, load, penalty, 0 AS last, 0 AS n, CAST([] AS VARCHAR[]) AS js, CAST([] AS VARCHAR[]) AS ss,
         CAST([] AS VARCHAR[]) AS ks, CAST(0 AS HUGEINT) AS worth, CAST(0 AS HUGEINT) AS depth
  FROM horizons, points
  UNION ALL
  SELECT t.mode, t.h, load, penalty, e.i, n + 1, list_append(js, e.j), list_append(ss, e.s), list_append(ks, e.k),
         worth + CAST(round(e.p * 1e12) AS HUGEINT)
           - CASE WHEN len(list_filter(ss, lambda x: x = e.s)) >= load
                  THEN CAST(round(penalty * 1e12) AS HUGEINT) ELSE 0 END,
         depth + CAST(pow(2, e.i) AS HUGEINT)
  FROM subsets t JOIN open_rows e ON e.mode = t.mode AND e.h = t.h AND e.i > t.last
  WHERE n < {most} AND NOT list_contains(js, e.j))"""


_BEST = """best AS (
  SELECT t.mode, t.h, c, unnest(ks) AS k FROM caps, horizons o
  JOIN subsets t ON t.mode = o.mode AND t.h = o.h AND t.n = least(c, o.journeys)
  QUALIFY row_number() OVER (PARTITION BY t.mode, t.h, c ORDER BY worth DESC, depth) = 1)"""
_CHOSEN = f"""chosen AS (
  SELECT '{SCORE_FIRST}' AS policy, c, mode, h, k FROM walk_score, caps WHERE turn <= c
  UNION ALL SELECT '{RANDOM}', c, mode, h, k FROM walk_random, caps WHERE turn <= c
  UNION ALL SELECT '{GREEDY}', c, mode, h, k FROM walk_greedy, caps WHERE turn BETWEEN 1 AND c
  UNION ALL SELECT '{EXACT}', c, mode, h, k FROM best_rows),
picked AS (SELECT policy, c, o.* FROM chosen JOIN open_rows o USING (mode, h, k))"""
_BEST_ROWS = _BEST.replace("best AS (", "best_sets AS (").replace("unnest(ks) AS k", "ks") + """,
best_rows AS (SELECT mode, h, c, unnest(ks) AS k FROM best_sets)"""

_PREPARED = (stops_cte(), SCORES, _CANDIDATES)
PICKED = (*_PREPARED, _SCORE_FIRST, _GREEDY, _subsets("[1]", "[0.2]", 10), _BEST_ROWS, _CHOSEN)


def recursive(*ctes: str, final: str) -> str:
    return with_ctes(*ctes, final=final).replace("WITH ", "WITH RECURSIVE ", 1)


def handed_over(spark, folder):
    """The scored rows as the stored hand-off that every selection step reads."""
    scores = held_out_scores(load_events(spark, folder), TEST_FROM, POLICY.selected_threshold, MODEL)
    return spool(scores, "scored")


def prepared(spark, folder, modes=tuple(SPLIT_OF_MODE)):
    return cand.prepare_candidates(handed_over(spark, folder), POLICY, modes)


def all_outcomes(candidates, policy=POLICY):
    return out.horizon_outcomes(cand.horizon_candidates(candidates), pol.choices(candidates, policy), policy)


# ---- candidates ----------------------------------------------------------------------------------

_CANDIDATE_COLUMNS = [
    "execution_mode",
    "horizon_id",
    "stop_event_key",
    "journey_id",
    "station_id",
    "is_eligible_candidate",
    "eligibility_reason",
    "candidate_priority_rank",
    "station_name",
    "train_type",
    "line_number",
    "train_service_key",
    "service_class",
    "prediction_split",
    "hour_of_day",
    "calendar_date",
    cand.PROBABILITY,
    cand.OUTCOME,
    "optimization_run_id",
    "optimized_at",
    "minimum_candidate_probability",
    "selected_threshold",
    "predicted_is_departure_severe_delay",
    "preferred_station_load_per_station_hour",
    "frozen_station_excess_penalty_lambda",
]
_CANDIDATES_FINAL = printed(
    f"""SELECT execution_mode, horizon_id, stop_event_key, journey_id, station_id,
    eligibility_reason = 'eligible' AS is_eligible_candidate, eligibility_reason,
    row_number() OVER (PARTITION BY execution_mode, horizon_id ORDER BY p DESC NULLS LAST, stop_event_key)
      AS candidate_priority_rank, station_name, train_type, line_number, train_service_key, service_class, prediction_split,
    hour_of_day, calendar_date, p AS {cand.PROBABILITY}, severe AS {cand.OUTCOME}, execution_mode || '-r1' AS optimization_run_id,
    '{POLICY.optimized_at}' AS optimized_at, CAST(0.5 AS DOUBLE) AS minimum_candidate_probability, CAST(0.5 AS DOUBLE) AS selected_threshold,
    coalesce(p >= 0.5, false) AS predicted_is_departure_severe_delay, 1 AS preferred_station_load_per_station_hour,
    CAST(0.2 AS DOUBLE) AS frozen_station_excess_penalty_lambda FROM cand""",
    doubles=f"{cand.PROBABILITY} minimum_candidate_probability selected_threshold frozen_station_excess_penalty_lambda",
)


@query(
    "candidates",
    with_ctes(*_PREPARED, final=_CANDIDATES_FINAL),
)
def candidates(spark, folder):
    return cand.rank_candidates(prepared(spark, folder)).select(*_CANDIDATE_COLUMNS)


@query(
    "candidates_without_attributes",
    with_ctes(
        *_PREPARED,
        final="""SELECT stop_event_key, eligibility_reason, CAST(NULL AS VARCHAR) AS station_name, CAST(NULL AS VARCHAR) AS train_service_key,
        CAST(NULL AS VARCHAR) AS service_class FROM cand""",
    ),
)
def candidates_without_attributes(spark, folder):
    """Scored rows that lack the optional columns get them as nulls."""
    bare = handed_over(spark, folder).drop("station_name", "train_service_key", "service_class")
    columns = ["stop_event_key", "eligibility_reason", "station_name", "train_service_key", "service_class"]
    return cand.prepare_candidates(bare, POLICY).select(*columns)


@query(
    "duplicate_candidates",
    with_ctes(
        *_PREPARED,
        """doubled AS (SELECT * FROM cand UNION ALL SELECT * FROM cand WHERE severe)""",
        final="""SELECT execution_mode, CASE WHEN count(*) OVER (PARTITION BY execution_mode, stop_event_key) > 1
            THEN 'duplicate_stop_event_key' ELSE eligibility_reason END AS eligibility_reason,
            stop_event_key FROM doubled""",
    ),
)
def duplicate_candidates(spark, folder):
    """Severe stops arrive twice: both copies become ineligible."""
    scores = handed_over(spark, folder)
    doubled = scores.unionByName(scores.filter(F.col(cand.OUTCOME)))
    return cand.prepare_candidates(doubled, POLICY).select("execution_mode", "eligibility_reason", "stop_event_key")


@query(
    "candidate_violations",
    with_ctes(
        *_PREPARED,
        final=printed(
            """SELECT execution_mode, count(*) FILTER (WHERE CAST(stop_event_key AS BIGINT) % 10 = 3) AS foreign_model_rows,
            count(*) FILTER (WHERE eligibility_reason = 'eligible') / count(*) AS eligible_share
            FROM cand GROUP BY 1""",
            doubles="eligible_share",
        ),
    ),
)
def candidate_violations(spark, folder):
    """Some rows come from another version of the model."""
    foreign = F.when(F.col("stop_event_key").cast("long") % 10 == 3, "older").otherwise(F.col("model_version"))
    return cand.candidate_violations(prepared(spark, folder).withColumn("model_version", foreign), POLICY)


@query(
    "opportunity",
    with_ctes(
        *_PREPARED,
        """per_station AS (SELECT mode, h, s, count(*) AS n FROM open_rows GROUP BY 1, 2, 3),
           crowd AS (SELECT mode, h, count(*) AS stations, max(n) AS most FROM per_station GROUP BY 1, 2)""",
        final=f"""SELECT mode AS execution_mode, calendar_date, hour_of_day, h AS horizon_id,
        {CANONICAL} AS capacity_per_hour, eligible_candidate_count AS eligible_event_count,
        journeys AS distinct_eligible_journey_count, coalesce(stations, 0) AS distinct_eligible_station_count,
        coalesce(most, 0) AS max_candidate_count_at_one_station,
        CAST(least({CANONICAL}, journeys) AS INTEGER) AS feasible_selection_target,
        coalesce(most, 0) > 1 AS station_excess_could_activate, journeys >= {CANONICAL} AS capacity_binds
        FROM horizons LEFT JOIN crowd USING (mode, h)""",
    ),
)
def opportunity(spark, folder):
    return cand.opportunity(cand.horizon_candidates(prepared(spark, folder)), CANONICAL)


# ---- policies ------------------------------------------------------------------------------------


def _policy_sql(name: str) -> str:
    return recursive(
        *PICKED,
        final=printed(
            f"""SELECT mode AS execution_mode, h AS horizon_id, policy AS policy_name, c AS capacity_per_hour,
            CAST(row_number() OVER (PARTITION BY mode, h, c ORDER BY i) AS INTEGER) AS selection_rank,
            k AS stop_event_key, j AS journey_id, s AS station_id, p AS predicted_severe_delay_probability,
            severe AS actual_is_departure_severe_delay FROM picked WHERE policy = '{name}'""",
            doubles="predicted_severe_delay_probability",
        ),
    )


def _policy_rows(name: str):
    def build(spark, folder):
        return pol.selections(pol.choices(prepared(spark, folder), POLICY, names=(name,)))

    return build


query("policy_ml_first", _policy_sql(SCORE_FIRST))(_policy_rows(SCORE_FIRST))
query("policy_random", _policy_sql(RANDOM))(_policy_rows(RANDOM))
query("policy_greedy", _policy_sql(GREEDY))(_policy_rows(GREEDY))
query("policy_exact", _policy_sql(EXACT))(_policy_rows(EXACT))

# ---- outcomes ------------------------------------------------------------------------------------

OUTCOMES = f"""policies AS (SELECT unnest(['{RANDOM}', '{SCORE_FIRST}', '{GREEDY}', '{EXACT}']) AS policy),
loads AS (SELECT policy, c, mode, h, s, count(*) AS n FROM picked GROUP BY ALL),
spread AS (SELECT policy, c, mode, h, count(*) AS stations, max(n) AS most, CAST(sum(n - 1) AS DOUBLE) AS excess
           FROM loads GROUP BY ALL),
gain AS (SELECT policy, c, mode, h, count(*) AS n, sum(p) AS total, count(*) FILTER (WHERE severe) AS hits,
                string_agg(k, '|' ORDER BY k) AS keys, list(k ORDER BY k) AS key_list FROM picked GROUP BY ALL),
result AS (
  SELECT o.mode || '-r1' AS optimization_run_id, o.mode AS execution_mode, policy AS policy_name, o.calendar_date,
         o.hour_of_day, o.h AS horizon_id, 'hourly_capacity_' || c AS capacity_scenario, c AS capacity_per_hour,
         CAST(least(c, o.journeys) AS INTEGER) AS feasible_selection_target, o.candidate_count,
         o.eligible_candidate_count, coalesce(g.n, 0) AS selected_event_count,
         CAST(c - least(c, o.journeys) AS INTEGER) AS candidate_shortage_count,
         CAST(c - coalesce(g.n, 0) AS INTEGER) AS unused_capacity,
         coalesce(g.total, 0.0) AS selected_probability_score_sum, coalesce(g.hits, 0) AS actual_severe_selected_count,
         coalesce(g.hits, 0) AS selected_severe_event_count, o.actual_severe_candidate_count,
         o.actual_severe_candidate_count / nullif(o.eligible_candidate_count, 0) AS candidate_prevalence,
         g.hits / g.n AS precision_at_capacity,
         coalesce(g.hits, 0) / nullif(o.actual_severe_candidate_count, 0) AS severe_delay_coverage,
         (g.hits / g.n) / nullif(o.actual_severe_candidate_count / nullif(o.eligible_candidate_count, 0), 0)
           AS lift_over_candidate_prevalence,
         coalesce(d.stations, 0) AS distinct_selected_stations,
         coalesce(d.most, 0) AS max_selected_same_station_in_horizon,
         coalesce(d.excess, 0.0) AS station_concentration_excess_total,
         coalesce(d.excess, 0.0) > 0 AS penalty_active_in_horizon,
         CASE WHEN policy = '{EXACT}' THEN 'OPTIMAL' ELSE 'deterministic' END AS solver_status,
         '{MODEL[0]}' AS scoring_model_name, '{MODEL[1]}' AS scoring_model_version,
         '{EXACT}' AS optimization_policy_name, '2026-06-29-v1' AS optimization_policy_version,
         1 AS preferred_station_load_per_station_hour, CAST(0.2 AS DOUBLE) AS frozen_station_excess_penalty_lambda,
         '{POLICY.optimized_at}' AS optimized_at, sha256(coalesce(g.keys, '')) AS selected_stop_event_key_hash,
         coalesce(g.key_list, CAST([] AS VARCHAR[])) AS key_list
  FROM horizons o CROSS JOIN policies CROSS JOIN caps
  LEFT JOIN gain g USING (policy, c, mode, h) LEFT JOIN spread d USING (policy, c, mode, h))"""
RESULT = (*PICKED, OUTCOMES)
_SUMMARY_DOUBLES = (
    "selected_probability_score_sum candidate_prevalence precision_at_capacity severe_delay_coverage "
    "lift_over_candidate_prevalence station_concentration_excess_total frozen_station_excess_penalty_lambda"
)


@query(
    "horizon_summary",
    recursive(
        *RESULT,
        final=printed(
            f"""SELECT {', '.join(out.SUMMARY_COLUMNS)} FROM result
            WHERE policy_name = '{EXACT}' AND capacity_per_hour = {CANONICAL}""",
            doubles=_SUMMARY_DOUBLES,
        ),
    ),
)
def horizon_summary(spark, folder):
    wanted = (F.col("policy_name") == EXACT) & (F.col("capacity_per_hour") == CANONICAL)
    return out.horizon_summary(all_outcomes(prepared(spark, folder))).filter(wanted)


@query(
    "horizon_policy_metrics",
    recursive(
        *RESULT,
        final=printed(
            f"SELECT {', '.join(out.SUMMARY_COLUMNS)}, selected_stop_event_key_hash FROM result",
            doubles=_SUMMARY_DOUBLES,
        ),
    ),
)
def horizon_policy_metrics(spark, folder):
    return out.horizon_policy_metrics(all_outcomes(prepared(spark, folder)))


COMPARISON = """covered AS (
  SELECT mode AS execution_mode, policy AS policy_name, c AS capacity_per_hour, count(DISTINCT s) AS stations
  FROM picked GROUP BY ALL),
compared AS (
  SELECT execution_mode, policy_name, capacity_scenario, capacity_per_hour,
         CAST(sum(selected_event_count) AS BIGINT) AS selected_event_count,
         CAST(sum(actual_severe_selected_count) AS BIGINT) AS selected_severe_event_count,
         sum(actual_severe_selected_count) / nullif(sum(selected_event_count), 0) AS precision_at_capacity,
         sum(actual_severe_selected_count) / nullif(sum(actual_severe_candidate_count), 0) AS severe_delay_coverage,
         sum(selected_probability_score_sum) AS expected_risk_score_captured,
         max(max_selected_same_station_in_horizon) AS max_selected_same_station_in_horizon,
         sum(station_concentration_excess_total) AS station_concentration_excess_total,
         CAST(sum(unused_capacity) AS BIGINT) AS unused_capacity_total,
         count(*) FILTER (WHERE feasible_selection_target = capacity_per_hour) AS binding_horizon_count,
         count(*) FILTER (WHERE feasible_selection_target = capacity_per_hour) / count(*) AS binding_horizon_rate,
         count(*) FILTER (WHERE candidate_shortage_count > 0) AS candidate_shortage_horizon_count,
         count(*) FILTER (WHERE candidate_shortage_count > 0) / count(*) AS candidate_shortage_horizon_rate,
         CAST(quantile_cont(feasible_selection_target, 0.5) AS DOUBLE) AS median_feasible_selection_target,
         1 AS preferred_station_load_per_station_hour, CAST(0.2 AS DOUBLE) AS frozen_station_excess_penalty_lambda
  FROM result GROUP BY 1, 2, 3, 4),
comparison AS (
  SELECT a.*, coalesce(v.stations, 0) AS distinct_stations_covered,
         a.precision_at_capacity / nullif(r.precision_at_capacity, 0) AS lift_vs_random
  FROM compared a LEFT JOIN covered v USING (execution_mode, policy_name, capacity_per_hour)
  LEFT JOIN compared r ON r.policy_name = 'random' AND r.execution_mode = a.execution_mode
   AND r.capacity_per_hour = a.capacity_per_hour)"""
_COMPARISON_DOUBLES = (
    "precision_at_capacity severe_delay_coverage expected_risk_score_captured station_concentration_excess_total "
    "binding_horizon_rate candidate_shortage_horizon_rate median_feasible_selection_target "
    "frozen_station_excess_penalty_lambda lift_vs_random"
)


@query(
    "policy_comparison",
    recursive(*RESULT, COMPARISON, final=printed("SELECT * FROM comparison", doubles=_COMPARISON_DOUBLES)),
)
def policy_comparison(spark, folder):
    return out.policy_comparison(spool(all_outcomes(prepared(spark, folder)), "outcomes"))


@query(
    "policy_objectives",
    recursive(
        *RESULT,
        final=printed(
            f"""SELECT execution_mode, policy_name, capacity_per_hour,
            sum(selected_probability_score_sum - CASE WHEN policy_name IN ('{GREEDY}', '{EXACT}')
              THEN 0.2 * station_concentration_excess_total ELSE 0 END) AS solver_objective_value
            FROM result GROUP BY 1, 2, 3""",
            doubles="solver_objective_value",
        ),
    ),
)
def policy_objectives(spark, folder):
    return out.objective_totals(all_outcomes(prepared(spark, folder)), POLICY)


def _pairwise_sql(reference: str) -> str:
    return recursive(
        *RESULT,
        f"""pairs AS (
          SELECT a.execution_mode, a.key_list AS x, b.key_list AS y, b.penalty_active_in_horizon AS active,
                 len(list_intersect(x, y)) AS common, len(list_distinct(list_concat(x, y))) AS total
          FROM result a JOIN result b USING (execution_mode, horizon_id, capacity_per_hour)
          WHERE a.policy_name = '{reference}' AND b.policy_name = '{EXACT}' AND capacity_per_hour = {CANONICAL})""",
        final=printed(
            """SELECT execution_mode, count(*) AS horizon_count, count(*) FILTER (WHERE x = y) AS matching_horizon_count,
            count(*) FILTER (WHERE x <> y) AS differing_horizon_count,
            count(*) FILTER (WHERE x = y) / count(*) AS selected_set_match_rate,
            avg(CASE WHEN total = 0 THEN 1.0 ELSE common / total END) AS mean_selected_set_jaccard,
            CAST(sum(total - common) AS BIGINT) AS selected_event_disagreement_count,
            count(*) FILTER (WHERE active) AS penalty_active_horizon_count FROM pairs GROUP BY 1""",
            doubles="selected_set_match_rate mean_selected_set_jaccard",
        ),
    )


def _pairwise(reference: str):
    def build(spark, folder):
        stored = spool(all_outcomes(prepared(spark, folder)), "outcomes")
        return out.pairwise_diagnostics(stored, reference, EXACT, CANONICAL)

    return build


query("pairwise_exact_vs_ml_first", _pairwise_sql(SCORE_FIRST))(_pairwise(SCORE_FIRST))
query("pairwise_exact_vs_greedy", _pairwise_sql(GREEDY))(_pairwise(GREEDY))

# ---- tuning --------------------------------------------------------------------------------------

_TUNING = (
    *_PREPARED,
    _subsets("[1, 2]", "[0.0, 0.05, 0.1, 0.2]", 3),
    """best_sets AS (
  SELECT t.mode, t.h, load, penalty, ks FROM horizons o
  JOIN subsets t ON t.mode = o.mode AND t.h = o.h AND t.n = least(3, o.journeys)
  QUALIFY row_number() OVER (PARTITION BY t.mode, t.h, load, penalty ORDER BY worth DESC, depth) = 1),
picked AS (
  SELECT b.load, b.penalty, o.* FROM (SELECT mode, h, load, penalty, unnest(ks) AS k FROM best_sets) b
  JOIN open_rows o USING (mode, h, k)),
loads AS (SELECT load, penalty, mode, h, s, count(*) AS n FROM picked GROUP BY ALL),
excess AS (SELECT load, penalty, mode, CAST(sum(greatest(n - load, 0)) AS DOUBLE) AS excess FROM loads GROUP BY ALL),
gains AS (SELECT load, penalty, mode, count(*) FILTER (WHERE severe) AS hits, count(DISTINCT s) AS stations
          FROM picked GROUP BY ALL),
sets AS (SELECT mode, h, load, penalty, list_sort(ks) AS ks FROM best_sets),
agree AS (SELECT a.mode, a.load, a.penalty, count(*) FILTER (WHERE a.ks = z.ks) AS same,
                 count(*) FILTER (WHERE a.ks <> z.ks) AS other
          FROM sets a JOIN sets z ON z.mode = a.mode AND z.h = a.h AND z.load = a.load AND z.penalty = 0 GROUP BY ALL),
totals AS (SELECT mode, CAST(sum(actual_severe_candidate_count) AS BIGINT) AS severe FROM horizons GROUP BY 1),
tuning AS (
  SELECT mode AS execution_mode, load AS preferred_station_load_per_station_hour,
         CAST(penalty AS DOUBLE) AS station_excess_penalty_lambda, penalty = 0 AS is_diagnostic_zero_penalty,
         'OPTIMAL' AS solver_status, hits AS selected_severe_event_count,
         severe AS total_actual_severe_candidate_count, hits / nullif(severe, 0) AS severe_delay_coverage,
         excess AS station_concentration_excess_total, stations AS distinct_stations_covered,
         same AS matching_horizon_count_vs_zero_penalty, other AS differing_horizon_count_vs_zero_penalty
  FROM gains JOIN excess USING (load, penalty, mode) JOIN agree USING (load, penalty, mode) JOIN totals USING (mode))""",
)
_TUNING_DOUBLES = "station_excess_penalty_lambda severe_delay_coverage station_concentration_excess_total"


def _tuning(spark, folder):
    candidates = prepared(spark, folder)
    searched = pol.search_choices(candidates, POLICY)
    return out.tuning_results(cand.horizon_candidates(candidates), searched, POLICY)


@query("tuning_grid", recursive(*_TUNING, final=printed("SELECT * FROM tuning", doubles=_TUNING_DOUBLES)))
def tuning_grid(spark, folder):
    return _tuning(spark, folder)


@query(
    "tuning_winner",
    recursive(
        *_TUNING,
        final=printed(
            """SELECT * FROM tuning WHERE execution_mode = 'development' AND NOT is_diagnostic_zero_penalty
            ORDER BY selected_severe_event_count DESC, severe_delay_coverage DESC, station_concentration_excess_total,
            distinct_stations_covered DESC, station_excess_penalty_lambda, preferred_station_load_per_station_hour
            LIMIT 1""",
            doubles=_TUNING_DOUBLES,
        ),
    ),
)
def tuning_winner(spark, folder):
    return out.tuning_winner(_tuning(spark, folder).filter(F.col("execution_mode") == "development"))


STOPPED_AT_ONCE = replace(
    POLICY,
    search=replace(
        POLICY.search, solver_step_limit=0, development_allowed_solver_statuses=(SOLVED, STOPPED), final_allowed_solver_statuses=(SOLVED,)
    ),
)


@query(
    "disallowed_statuses_of_the_feed",
    recursive(
        *RESULT,
        f"""scores_of AS (
          SELECT mode, h, c, max(worth) FILTER (WHERE policy = '{GREEDY}') AS held, max(worth) FILTER (WHERE policy = '{EXACT}') AS best
          FROM (SELECT execution_mode AS mode, horizon_id AS h, capacity_per_hour AS c, policy_name AS policy,
                       selected_probability_score_sum - 0.2 * station_concentration_excess_total AS worth FROM result) GROUP BY 1, 2, 3)""",
        final=f"""SELECT mode AS execution_mode, '{STOPPED}' AS solver_status, count(*) AS choice_count
        FROM scores_of WHERE mode = 'final' AND best - held > 1e-9 GROUP BY 1""",
    ),
)
def disallowed_statuses_of_the_feed(spark, folder):
    """The same on the feed, whose hours hold so few rows that choices row by row are mostly the best."""
    return out.disallowed_statuses(all_outcomes(prepared(spark, folder), STOPPED_AT_ONCE), STOPPED_AT_ONCE)
