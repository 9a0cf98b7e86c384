"""Star-schema export, quality rules and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from delaymill.config import EXACT
from delaymill.operators import export as ex
from delaymill.operators import outcomes as out
from delaymill.operators import candidates as cand
from delaymill.operators import quality, report
from delaymill.session import spool
from delaymill.sources.sample_feed import load_events, stop_events
from registry.common import feed, printed, query, with_ctes
from registry.layers import _GOLD, layer_frames
from registry.selection import (
    CANONICAL,
    COMPARISON,
    MODEL,
    POLICY,
    RESULT,
    _COMPARISON_DOUBLES,
    _SUMMARY_DOUBLES,
    all_outcomes,
    prepared,
    recursive,
)

VERSION = POLICY.search.optimization_policy_version

# ---- SQL of the exported tables ------------------------------------------------------------------

_STAR = f"""names AS (SELECT eva AS station_id, min(station_name) AS found FROM stops GROUP BY 1),
final_picks AS (
  SELECT h AS horizon_id, k AS stop_event_key,
         CAST(row_number() OVER (PARTITION BY h ORDER BY i) AS INTEGER) AS selection_rank
  FROM picked WHERE policy = '{EXACT}' AND c = {CANONICAL} AND mode = 'final'),
event_fact AS (
  SELECT 'final-r1' AS optimization_run_id, execution_mode, '{VERSION}' AS scenario_key,
         'hourly_capacity_3' AS capacity_scenario, 3 AS capacity_per_hour,
         CAST(0.5 AS DOUBLE) AS minimum_candidate_probability, calendar_date, hour_of_day, horizon_id, stop_event_key,
         journey_id, station_id, coalesce(station_name, found, 'Unknown station') AS station_name, train_type,
         coalesce(line_number, 'Not provided in source') AS line_number, train_service_key, service_class,
         p AS predicted_severe_delay_probability, severe AS actual_is_departure_severe_delay, prediction_split,
         eligibility_reason = 'eligible' AS is_eligible_candidate, eligibility_reason,
         selection_rank IS NOT NULL AS selected_for_review,
         row_number() OVER (PARTITION BY horizon_id ORDER BY p DESC NULLS LAST, stop_event_key)
           AS candidate_priority_rank,
         selection_rank, p AS priority_score, CASE WHEN selection_rank IS NULL THEN 0.0 ELSE p END
           AS objective_contribution, 2 AS solver_status, '{MODEL[0]}' AS model_name, '{MODEL[1]}' AS model_version,
         CAST(0.5 AS DOUBLE) AS selected_threshold, '{POLICY.optimized_at}' AS optimized_at,
         round((p - p % CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) * 0.05 AS "{ex.BIN}",
         CASE eligibility_reason WHEN 'eligible' THEN 'Can be reviewed' ELSE 'Not reviewable' END
           AS "Review Eligibility",
         CASE WHEN eligibility_reason <> 'eligible' THEN 'Not reviewable' WHEN selection_rank IS NULL
              THEN 'Not chosen for review' ELSE 'Chosen for review' END AS "Review Decision",
         CASE WHEN severe THEN 'Became severe' ELSE 'Did not become severe' END AS "Actual Outcome",
         CASE WHEN p IS NULL THEN 'Unknown' WHEN p < 0.1 THEN '00-10%' WHEN p < 0.2 THEN '10-20%'
              WHEN p < 0.3 THEN '20-30%' WHEN p < 0.4 THEN '30-40%' WHEN p < 0.5 THEN '40-50%'
              WHEN p < 0.6 THEN '50-60%' WHEN p < 0.7 THEN '60-70%' WHEN p < 0.8 THEN '70-80%'
              WHEN p < 0.9 THEN '80-90%' ELSE '90-100%' END AS "Predicted Risk Band",
         CASE WHEN p IS NULL THEN 99 ELSE least(10, CAST(floor(p * 10) AS INTEGER) + 1) END
           AS "Predicted Risk Band Sort"
  FROM cand LEFT JOIN final_picks USING (horizon_id, stop_event_key) LEFT JOIN names USING (station_id)
  WHERE execution_mode = 'final'),
horizon_fact AS (
  SELECT optimization_run_id, execution_mode, '{VERSION}' AS scenario_key, calendar_date, hour_of_day, horizon_id,
         capacity_scenario, capacity_per_hour, candidate_count, eligible_candidate_count, selected_event_count,
         unused_capacity, selected_probability_score_sum, actual_severe_selected_count, actual_severe_candidate_count,
         candidate_prevalence, precision_at_capacity, severe_delay_coverage, lift_over_candidate_prevalence,
         2 AS solver_status, scoring_model_name AS model_name, scoring_model_version AS model_version, optimized_at
  FROM result WHERE policy_name = '{EXACT}' AND capacity_per_hour = {CANONICAL} AND execution_mode = 'final')"""
STAR = (*RESULT, _STAR)
def star_sql(body: str, doubles: str = "", *ctes: str) -> str:
    return recursive(*STAR, *ctes, final=printed(body, doubles=doubles))


# ---- Spark side ----------------------------------------------------------------------------------


def _final(spark, folder):
    """Candidates and outcomes of the final mode, stored once for everything that reads them."""
    ranked = cand.rank_candidates(prepared(spark, folder, ("final",)))
    return ranked, spool(all_outcomes(ranked), "outcomes")


def star(spark, folder, final=None):
    """Events, horizon summary and star tables; ``final`` hands over what ``_final`` has stored already."""
    ranked, outcomes = final or _final(spark, folder)
    decisions = out.event_decisions(ranked, outcomes, POLICY, EXACT, CANONICAL)
    names = spool(ex.station_names(stop_events(load_events(spark, folder))), "station_names")
    events = spool(ex.normalized_events(decisions, POLICY, names), "events")
    wanted = (F.col("policy_name") == EXACT) & (F.col("capacity_per_hour") == CANONICAL)
    summary = out.horizon_summary(outcomes).filter(wanted)
    return events, summary, ex.star_tables(spark, events, summary, POLICY)


def exported(spark, folder):
    """The star tables that report queries read."""
    return star(spark, folder)[2]


def policy_facts(spark, folder, final=None):
    _, outcomes = final or _final(spark, folder)
    metrics = ex.fact_horizon_policy_metrics(out.horizon_policy_metrics(outcomes))
    comparison = ex.fact_policy_comparison(out.policy_comparison(outcomes), metrics)
    return metrics, comparison, ex.fact_policy_pairwise_summary(comparison, metrics)


_EVENT_DOUBLES = (
    "minimum_candidate_probability predicted_severe_delay_probability priority_score "
    "objective_contribution selected_threshold"
)


def _event_sql() -> str:
    columns = ", ".join(f'"{c["name"]}"' for c in ex.CONTRACTS["fact_event_decision"])
    binned = f'SELECT {columns} FROM (SELECT * REPLACE (round("{ex.BIN}" + 1e-9, 6) AS "{ex.BIN}") FROM event_fact)'
    return star_sql(binned, _EVENT_DOUBLES)


@query("fact_event_decision", _event_sql())
def fact_event_decision(spark, folder):
    return star(spark, folder)[2]["fact_event_decision"]


_HORIZON_DOUBLES = (
    "selected_probability_score_sum candidate_prevalence precision_at_capacity severe_delay_coverage "
    "lift_over_candidate_prevalence"
)


@query("fact_horizon_summary", star_sql("SELECT * FROM horizon_fact", _HORIZON_DOUBLES))
def fact_horizon_summary(spark, folder):
    return star(spark, folder)[2]["fact_horizon_summary"]


@query(
    "dim_date_hour",
    star_sql(
        """SELECT horizon_id, calendar_date, hour_of_day, calendar_date AS date_label,
        lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || ':59'
          AS hour_label FROM horizon_fact"""
    ),
)
def dim_date_hour(spark, folder):
    return star(spark, folder)[2]["dim_date_hour"]


@query("dim_review_station", star_sql("SELECT DISTINCT station_id, station_name FROM event_fact"))
def dim_review_station(spark, folder):
    return star(spark, folder)[2]["dim_station"]


@query(
    "dim_review_service",
    star_sql("SELECT DISTINCT train_service_key, train_type, line_number, service_class FROM event_fact"),
)
def dim_review_service(spark, folder):
    return star(spark, folder)[2]["dim_train_service"]


_SCENARIO_NAME = f"Prototype hourly_capacity_3 | threshold 0.50 | policy {VERSION}"


@query(
    "events_by_scenario",
    star_sql(
        f"""SELECT s.*, n AS "Event Count" FROM (SELECT scenario_key, count(*) AS n FROM event_fact GROUP BY 1) JOIN (
        SELECT '{VERSION}' AS scenario_key, 'hourly_capacity_{CANONICAL}' AS capacity_scenario, {CANONICAL} AS capacity_per_hour,
        {POLICY.threshold} AS minimum_candidate_probability, '{MODEL[0]}' AS model_name, '{MODEL[1]}' AS model_version,
        {POLICY.selected_threshold} AS selected_threshold, '{VERSION}' AS policy_version, '{POLICY.frozen_at}' AS frozen_at,
        '{_SCENARIO_NAME}' AS scenario_display_name) s USING (scenario_key)""",
        "minimum_candidate_probability selected_threshold",
    ),
)
def events_by_scenario(spark, folder):
    """The scenario dimension, all its columns, joined to its events."""
    tables = star(spark, folder)[2]
    axes = tables["dim_scenario"].columns
    shared = {c for c in axes if c != "scenario_key" and c in tables["fact_event_decision"].columns}
    joined = report.with_dimension(tables["fact_event_decision"].drop(*shared), tables["dim_scenario"], "scenario_key")
    return report.report(joined, axes, report.some(report.event_measures(), "Event Count"))


# ---- policy facts --------------------------------------------------------------------------------

_DISPLAY = """display AS (SELECT * FROM (VALUES ('random', 'Random', 1), ('ml_first', 'ML-first', 2),
  ('constrained_greedy', 'Constrained greedy', 3), ('exact_soft_station_penalty', 'Exact', 4))
  AS t(policy_name, policy_display_name, policy_sort_order))"""
_PRINTS = """pools AS (
  SELECT DISTINCT capacity_per_hour, horizon_id, '{"horizon_id":"' || horizon_id || '","candidate_count":' || candidate_count
    || ',"eligible_candidate_count":' || eligible_candidate_count || ',"feasible_selection_target":'
    || feasible_selection_target || ',"actual_severe_candidate_count":' || actual_severe_candidate_count || '}' AS entry
  FROM result WHERE execution_mode = 'final'),
prints AS (SELECT capacity_per_hour, sha256('[' || string_agg(entry, ',' ORDER BY horizon_id) || ']')
             AS candidate_pool_fingerprint FROM pools GROUP BY 1),
metrics AS (SELECT r.*, policy_display_name, policy_sort_order, candidate_pool_fingerprint FROM result r
  JOIN display USING (policy_name) JOIN prints USING (capacity_per_hour) WHERE execution_mode = 'final')"""
_COMPARED = f"""comparison_fact AS (
  SELECT 'final-r1' AS optimization_run_id, c.*, policy_display_name, policy_sort_order, candidate_pool_fingerprint,
         binding_horizon_count + candidate_shortage_horizon_count AS horizon_count,
         station_concentration_excess_total / nullif(binding_horizon_count + candidate_shortage_horizon_count, 0)
           AS mean_station_concentration_excess_per_horizon,
         unused_capacity_total / nullif(binding_horizon_count + candidate_shortage_horizon_count, 0)
           AS mean_unused_capacity_per_horizon,
         '{MODEL[0]}' AS scoring_model_name, '{MODEL[1]}' AS scoring_model_version,
         '{VERSION}' AS optimization_policy_version, '{POLICY.optimized_at}' AS optimized_at
  FROM comparison c JOIN display USING (policy_name) JOIN prints USING (capacity_per_hour)
  WHERE execution_mode = 'final')"""
_POLICY_FACTS = (*RESULT, COMPARISON, _DISPLAY, _PRINTS, _COMPARED)
_MEANS = "mean_station_concentration_excess_per_horizon mean_unused_capacity_per_horizon"


@query(
    "fact_horizon_policy_metrics",
    recursive(
        *_POLICY_FACTS,
        final=printed(f"SELECT {', '.join(ex.METRIC_COLUMNS)} FROM metrics", doubles=_SUMMARY_DOUBLES),
    ),
)
def fact_horizon_policy_metrics(spark, folder):
    return policy_facts(spark, folder)[0]


@query(
    "fact_policy_comparison",
    recursive(
        *_POLICY_FACTS,
        final=printed(
            f"SELECT {', '.join(ex.COMPARISON_COLUMNS)} FROM comparison_fact", doubles=f"{_COMPARISON_DOUBLES} {_MEANS}"
        ),
    ),
)
def fact_policy_comparison(spark, folder):
    return policy_facts(spark, folder)[1]


_DUELS = f"""duels AS (
          SELECT a.capacity_per_hour, b.policy_name,
                 a.selected_stop_event_key_hash = b.selected_stop_event_key_hash AS equal,
                 coalesce(nullif(sign(a.actual_severe_selected_count - b.actual_severe_selected_count), 0),
                   nullif(sign(round(a.selected_probability_score_sum, 12) - round(b.selected_probability_score_sum, 12)), 0),
                   nullif(sign(b.station_concentration_excess_total - a.station_concentration_excess_total), 0),
                   sign(b.unused_capacity - a.unused_capacity)) AS verdict
          FROM metrics a JOIN metrics b USING (capacity_per_hour, horizon_id)
          WHERE a.policy_name = '{EXACT}' AND b.policy_name <> '{EXACT}'),
        tallies AS (SELECT capacity_per_hour, policy_name, count(*) AS compared_horizon_count,
          count(*) FILTER (WHERE verdict > 0) AS win_horizon_count,
          count(*) FILTER (WHERE verdict = 0) AS tie_horizon_count,
          count(*) FILTER (WHERE verdict < 0) AS loss_horizon_count,
          avg(CAST(equal AS INTEGER)) AS selected_set_match_rate FROM duels GROUP BY 1, 2)"""
_JUDGED = ["selected_severe_event_count", "precision_at_capacity", "severe_delay_coverage", *_MEANS.split()]
_PAIR = ", ".join(
    [f"e.{c} AS reference_{c}" for c in ["policy_name", "policy_display_name", *_JUDGED]]
    + [f"o.{c} AS comparator_{c}" for c in ["policy_name", "policy_display_name", *_JUDGED]]
    + [f"e.{c} - o.{c} AS {c}_delta" for c in _JUDGED]
)
_PAIR_DOUBLES = " ".join(
    ["selected_set_match_rate"]
    + [f"{side}_{c}" for side in ("reference", "comparator") for c in _JUDGED[1:]]
    + [f"{c}_delta" for c in _JUDGED[1:]]
)


_PAIR_FACT = f"""pair_fact AS (
  SELECT 'final' AS execution_mode, t.capacity_per_hour, compared_horizon_count, win_horizon_count,
         tie_horizon_count, loss_horizon_count, selected_set_match_rate, {_PAIR}, e.optimization_run_id,
         e.candidate_pool_fingerprint, e.scoring_model_name, e.scoring_model_version, e.optimization_policy_version, e.optimized_at
  FROM tallies t JOIN comparison_fact o USING (capacity_per_hour, policy_name)
  JOIN comparison_fact e ON e.capacity_per_hour = t.capacity_per_hour AND e.policy_name = '{EXACT}')"""


@query(
    "pairwise_summary",
    recursive(*_POLICY_FACTS, _DUELS, _PAIR_FACT, final=printed("SELECT * FROM pair_fact", doubles=_PAIR_DOUBLES)),
)
def pairwise_summary(spark, folder):
    return policy_facts(spark, folder)[2]


@query(
    "policy_table",
    recursive(
        *_POLICY_FACTS,
        final=printed(
            f"""SELECT capacity_per_hour, policy_display_name, selected_event_count, selected_severe_event_count,
            precision_at_capacity, severe_delay_coverage FROM comparison_fact WHERE capacity_per_hour = {CANONICAL}""",
            doubles="precision_at_capacity severe_delay_coverage",
        ),
    ),
)
def policy_table(spark, folder):
    columns = [
        "capacity_per_hour",
        "policy_display_name",
        "selected_event_count",
        "selected_severe_event_count",
        "precision_at_capacity",
        "severe_delay_coverage",
    ]
    return report.policy_table(policy_facts(spark, folder)[1], CANONICAL).select(*columns)


# ---- quality -------------------------------------------------------------------------------------


@query(
    "layer_quality",
    with_ctes(
        *_GOLD,
        final="""SELECT 'rows without key' AS rule, count(*) FILTER (WHERE stop_event_key IS NULL) AS violations FROM gold
        UNION ALL SELECT 'severe before departure', count(*) FILTER (WHERE departure_delay_min IS NULL
            AND is_severe_delay) FROM gold
        UNION ALL SELECT 'one row per event', count(*) FROM
            (SELECT 1 FROM gold GROUP BY stop_event_key HAVING count(*) > 1)
        UNION ALL SELECT 'one row per station and service', count(*) FROM
            (SELECT 1 FROM gold GROUP BY station_key, train_service_key HAVING count(*) > 1)
        UNION ALL SELECT 'station fixes its name', count(*) FROM
            (SELECT 1 FROM gold GROUP BY station_id HAVING count(DISTINCT station_name) > 1)
        UNION ALL SELECT 'journey fixes its line', count(*) FROM (SELECT 1 FROM gold GROUP BY journey_id
            HAVING count(DISTINCT coalesce(train_type, '?')) > 1 OR count(DISTINCT coalesce(line_number, '?')) > 1)
        UNION ALL SELECT 'fact stations are known', count(DISTINCT station_key) FROM gold WHERE station_key % 5 = 0
        UNION ALL SELECT 'peak stations serve at night', count(*) FROM (SELECT DISTINCT station_key FROM gold
            WHERE time_band = 'peak') WHERE station_key NOT IN (SELECT station_key FROM gold WHERE hour_key < 3)
        UNION ALL SELECT 'one file, one band', CAST(count(DISTINCT source_file) <> 1 AS BIGINT) + CAST(count(DISTINCT time_band) <> 1 AS BIGINT) FROM gold""",
    ),
)
def layer_quality(spark, folder):
    """Every kind of rule, some of them broken on purpose, on the feature layer."""
    stations, _, fact, gold = layer_frames(feed(spark, folder))
    gold = spool(gold, "gold")
    peak, night = gold.filter("time_band = 'peak'"), gold.filter("hour_key < 3").select("station_key").distinct()
    return quality.union_reports(
        quality.row_rules(
            gold,
            {
                "rows without key": F.col("stop_event_key").isNull(),
                "severe before departure": F.col("departure_delay_min").isNull() & F.col("is_severe_delay"),
            },
        ),
        quality.duplicate_keys(gold, ["stop_event_key"], "one row per event"),
        quality.duplicate_keys(gold, ["station_key", "train_service_key"], "one row per station and service"),
        quality.broken_dependency(gold, "station_id", ["station_name"], "station fixes its name"),
        quality.broken_dependency(gold, "journey_id", ["train_type", "line_number"], "journey fixes its line"),
        quality.orphans(fact, stations.filter("station_key % 5 <> 0"), "station_key", "fact stations are known"),
        quality.orphans(peak, night, "station_key", "peak stations serve at night"),
        quality.single_value(gold, ["source_file", "time_band"], "one file, one band"),
    )


@query(
    "reconciliation",
    recursive(
        *STAR,
        final="""SELECT rule || ' agrees with events' AS rule, count(*) FILTER (WHERE bad) AS violations FROM (
          SELECT unnest(['candidate_count', 'eligible_candidate_count', 'selected_event_count',
                         'actual_severe_selected_count', 'actual_severe_candidate_count',
                         'selected_probability_score_sum']) AS rule,
                 unnest([h.candidate_count IS DISTINCT FROM e.n, h.eligible_candidate_count IS DISTINCT FROM e.o,
                         h.selected_event_count IS DISTINCT FROM e.c, h.actual_severe_selected_count IS DISTINCT FROM e.cs,
                         h.actual_severe_candidate_count IS DISTINCT FROM e.os,
                         round(h.selected_probability_score_sum, 9) IS DISTINCT FROM round(e.total, 9)]) AS bad
          FROM horizon_fact h FULL JOIN (
            SELECT horizon_id, count(*) AS n, count(*) FILTER (WHERE is_eligible_candidate) AS o,
                   count(*) FILTER (WHERE selected_for_review) AS c,
                   count(*) FILTER (WHERE selected_for_review AND actual_is_departure_severe_delay) AS cs,
                   count(*) FILTER (WHERE is_eligible_candidate AND actual_is_departure_severe_delay) AS os,
                   sum(objective_contribution) AS total FROM event_fact GROUP BY 1) e USING (horizon_id)) GROUP BY 1""",
    ),
)
def reconciliation(spark, folder):
    events, summary, tables = star(spark, folder)
    return ex.reconciliation(events, tables["fact_horizon_summary"])


_SQL_TABLES = {
    "fact_event_decision": "event_fact",
    "fact_horizon_summary": "horizon_fact",
    "fact_policy_comparison": "comparison_fact",
    "fact_horizon_policy_metrics": "metrics",
    "fact_policy_pairwise_summary": "pair_fact",
    "dim_date_hour": "date_hours",
    "dim_station": "station_names",
    "dim_train_service": "service_names",
    "dim_scenario": "scenarios",
}
_SQL_DIMENSIONS = f"""date_hours AS (SELECT DISTINCT horizon_id, calendar_date, hour_of_day, calendar_date AS date_label,
    hour_of_day || ':00' AS hour_label FROM horizon_fact),
station_names AS (SELECT DISTINCT station_id, station_name FROM event_fact),
service_names AS (SELECT DISTINCT train_service_key, train_type, line_number, service_class FROM event_fact),
scenarios AS (SELECT '{VERSION}' AS scenario_key, 'hourly_capacity_3' AS capacity_scenario, 3 AS capacity_per_hour,
    0.5 AS minimum_candidate_probability, '{MODEL[0]}' AS model_name, '{MODEL[1]}' AS model_version,
    0.5 AS selected_threshold, '{VERSION}' AS policy_version, '{POLICY.frozen_at}' AS frozen_at,
    '{_SCENARIO_NAME}' AS scenario_display_name)"""


def _bad_rows(rule: str, table: str, condition: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {table}"


def _bad_groups(rule: str, table: str, keys: str, condition: str) -> str:
    return f"SELECT '{rule}', count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING {condition})"


def _quality_sql() -> str:
    """Every rule of the export, counted in SQL on the SQL side's own tables."""
    events = {
        "events are final": "execution_mode <> 'final'",
        "events are test rows": "prediction_split <> 'test'",
        "events have stations": "station_id IS NULL",
        "events have services": "train_service_key IS NULL",
        "events have horizons": "horizon_id IS NULL",
        "events use the policy capacity": "capacity_per_hour <> 3",
        "events use the policy scenario": "capacity_scenario <> 'hourly_capacity_3'",
        "events use the policy threshold": "selected_threshold <> 0.5",
        "events use the minimum probability": "minimum_candidate_probability <> 0.5",
        "events use the policy model": f"model_name <> '{MODEL[0]}' OR model_version <> '{MODEL[1]}'",
    }
    horizons = {
        "horizons are final": "execution_mode <> 'final'",
        "horizons use the policy capacity": "capacity_per_hour <> 3",
        "horizons use the policy scenario": "capacity_scenario <> 'hourly_capacity_3'",
    }
    run = "optimization_run_id"
    grain = f"{run}, capacity_per_hour, policy_name"
    pool = "candidate_count eligible_candidate_count feasible_selection_target actual_severe_candidate_count".split()
    mixed = " OR ".join(f"min({c}) <> max({c})" for c in pool)
    service = " OR ".join(f"count(DISTINCT {c}) > 1" for c in ("train_type", "line_number", "service_class"))
    per_horizon = "execution_mode, capacity_per_hour, horizon_id"
    rules = [
        *[_bad_rows(rule, "event_fact", bad) for rule, bad in events.items()],
        *[_bad_rows(rule, "horizon_fact", bad) for rule, bad in horizons.items()],
        _bad_groups("one row per event", "event_fact", "stop_event_key", "count(*) > 1"),
        _bad_groups("one row per horizon", "horizon_fact", "horizon_id", "count(*) > 1"),
        _bad_groups(
            "horizon fixes date and hour",
            "event_fact",
            "horizon_id",
            "count(DISTINCT calendar_date) > 1 OR count(DISTINCT hour_of_day) > 1",
        ),
        "SELECT 'one run and model', "
        + " + ".join(f"CAST(count(DISTINCT {c}) <> 1 AS BIGINT)" for c in (run, "model_name", "model_version"))
        + " FROM event_fact",
        f"""SELECT 'one run in all tables', CAST(count(DISTINCT {run}) <> 1 AS BIGINT) FROM
            (SELECT {run} FROM event_fact UNION ALL SELECT {run} FROM horizon_fact)""",
        _bad_groups("station fixes its name", "event_fact", "station_id", "count(DISTINCT station_name) > 1"),
        _bad_groups("service fixes its attributes", "event_fact", "train_service_key", service),
        _bad_groups("metrics hold every policy", "metrics", "capacity_per_hour", "count(DISTINCT policy_name) <> 4"),
        _bad_groups(
            "comparison holds every policy", "comparison_fact", "capacity_per_hour", "count(DISTINCT policy_name) <> 4"
        ),
        _bad_groups("policies share a candidate pool", "metrics", per_horizon, mixed),
        _bad_groups("every policy decides every horizon", "metrics", per_horizon, "count(*) <> 4"),
        _bad_groups("one comparison row per policy", "comparison_fact", grain, "count(*) > 1"),
        _bad_groups("one metrics row per policy and horizon", "metrics", f"{grain}, horizon_id", "count(*) > 1"),
        _bad_rows(
            "wins, ties and losses add up",
            "tallies",
            "win_horizon_count + tie_horizon_count + loss_horizon_count <> compared_horizon_count",
        ),
    ]
    for table, columns in ex.CONTRACTS.items():
        for c in columns:
            name = c["name"]
            if not c["nullable"]:
                rules.append(_bad_rows(f"{table}.{name} is null", _SQL_TABLES[table], f'"{name}" IS NULL'))
            if c["range"]:
                outside = f'"{name}" NOT BETWEEN 0 AND 1'
                rules.append(_bad_rows(f"{table}.{name} out of range", _SQL_TABLES[table], outside))
    for fact, dimension, key in ex.RELATIONSHIPS:
        rules.append(
            f"SELECT '{fact}.{key} in {dimension}', count(DISTINCT {key}) FROM {_SQL_TABLES[fact]}"
            f" WHERE {key} NOT IN (SELECT {key} FROM {_SQL_TABLES[dimension]})"
        )
    for dimension, key in sorted({(d, k) for _, d, k in ex.RELATIONSHIPS}):
        rules.append(_bad_groups(f"{dimension}.{key} is unique", _SQL_TABLES[dimension], key, "count(*) > 1"))
    tables = (*STAR, COMPARISON, _DISPLAY, _PRINTS, _COMPARED, _DUELS, _PAIR_FACT, _SQL_DIMENSIONS)
    return recursive(*tables, final=" UNION ALL ".join(rules))


_ODD = "CAST(stop_event_key AS BIGINT) % 10 = 3"
_LATE = "hour_of_day >= 18"
_ARTIFACT_FIELDS = {
    "optimization_run_id": ("optimization_run_id", None),
    "model_name": ("model_name", f"'{MODEL[0]}'"),
    "model_version": (f"CASE WHEN {_ODD} THEN 'older' ELSE model_version END", f"'{MODEL[1]}'"),
    "capacity_scenario": ("capacity_scenario", f"'hourly_capacity_{CANONICAL}'"),
    "capacity_per_hour": ("capacity_per_hour", str(CANONICAL)),
    "minimum_candidate_probability": ("minimum_candidate_probability", str(POLICY.threshold)),
    "selected_threshold": ("selected_threshold", str(POLICY.selected_threshold)),
}
_HORIZON_FIELDS = {
    "optimization_run_id": (f"CASE WHEN {_LATE} THEN 'final-r2' ELSE optimization_run_id END", None),
    "model_name": ("CAST(NULL AS VARCHAR)", f"'{MODEL[0]}'"),
    "model_version": ("model_version", f"'{MODEL[1]}'"),
    "capacity_scenario": ("capacity_scenario", f"'hourly_capacity_{CANONICAL}'"),
    "capacity_per_hour": (f"CASE WHEN {_LATE} THEN 5 ELSE capacity_per_hour END", str(CANONICAL)),
}
_EVALUATED = {"selected_threshold": 0.6, "capacity_per_hour": 3}  # what the metadata claim; the threshold is wrong
_CLAIMED_HORIZONS = 7


def _artifact_sql() -> str:
    rules = []
    for side, table, fields in (("events", "event_fact", _ARTIFACT_FIELDS), ("horizons", "horizon_fact", _HORIZON_FIELDS)):
        for field, (value, expected) in fields.items():
            rules.append(f"SELECT '{side}: one known {field}' AS rule, abs(count(DISTINCT {value}) - 1) AS violations FROM {table}")
            if expected:
                rules.append(f"SELECT '{side}: {field} is that of the policy', count(*) FILTER (WHERE {value} <> {expected}) FROM {table}")
            if field in _EVALUATED:
                rules.append(
                    f"SELECT '{side}: {field} is that of the metadata', count(*) FILTER (WHERE {value} <> {_EVALUATED[field]}) FROM {table}"
                )
    late = _HORIZON_FIELDS["optimization_run_id"][0]
    rules.append(
        f"""SELECT 'events and horizons: same optimization_run_id', count(*) FROM (
        (SELECT DISTINCT {late} AS id FROM horizon_fact EXCEPT SELECT optimization_run_id FROM event_fact)
        UNION ALL (SELECT optimization_run_id FROM event_fact EXCEPT SELECT {late} FROM horizon_fact))"""
    )
    rules.append(f"SELECT 'horizons: as many as the metadata say', abs(count(*) - {_CLAIMED_HORIZONS}) FROM horizon_fact")
    return recursive(*STAR, final=" UNION ALL ".join(rules))


@query("artifact_agreement", _artifact_sql())
def artifact_agreement(spark, folder):
    """Events and horizons that do not describe one run: versions, run ids, capacities and metadata are mixed up on purpose."""
    events, summary, _ = star(spark, folder)
    events = events.withColumn("model_version", F.when(F.col("stop_event_key").cast("long") % 10 == 3, "older").otherwise(F.col("model_version")))
    late = F.expr(_LATE)
    summary = summary.withColumns({
        "optimization_run_id": F.when(late, "final-r2").otherwise(F.col("optimization_run_id")),
        "capacity_per_hour": F.when(late, 5).otherwise(F.col("capacity_per_hour")),
        "scoring_model_name": F.lit(None).cast("string"),
    })
    return ex.artifact_violations(events, summary, POLICY, _EVALUATED, _CLAIMED_HORIZONS)


_RUN_FIELDS = {
    "optimization_run_id": f"CASE WHEN capacity_per_hour = 5 AND {_LATE} THEN 'final-r2' ELSE optimization_run_id END",
    "candidate_pool_fingerprint": "candidate_pool_fingerprint",
    "scoring_model_name": "scoring_model_name",
    "scoring_model_version": f"CASE WHEN capacity_per_hour IN (1, 10) AND {_LATE} THEN NULL ELSE scoring_model_version END",
    "optimization_policy_version": "optimization_policy_version",
    "optimized_at": "CAST(NULL AS VARCHAR)",
}


@query(
    "run_metadata",
    recursive(
        *_POLICY_FACTS,
        final=" UNION ALL ".join(
            f"""SELECT 'one {field} per capacity' AS rule, count(*) AS violations FROM (SELECT 1 FROM metrics WHERE capacity_per_hour <> 3
            GROUP BY capacity_per_hour HAVING count(DISTINCT {value}) <> 1 OR count({value}) <> count(*))"""
            for field, value in _RUN_FIELDS.items()
        )
        + " UNION ALL SELECT 'comparison rows have a run', count(*) FROM comparison_fact WHERE capacity_per_hour = 3",
    ),
)
def run_metadata(spark, folder):
    """Conflicting, partly unknown and missing run metadata, by capacity."""
    metrics, comparison, _ = policy_facts(spark, folder)
    mixed = metrics.filter("capacity_per_hour <> 3").withColumns({c: F.expr(sql) for c, sql in _RUN_FIELDS.items() if "CASE" in sql})
    return ex.run_violations(mixed.withColumn("optimized_at", F.lit(None).cast("string")), comparison)


@query("export_quality", _quality_sql())
def export_quality(spark, folder):
    """All rules of the export; every count must be zero."""
    final = _final(spark, folder)
    events, summary, tables = star(spark, folder, final)
    metrics, comparison, pairwise = policy_facts(spark, folder, final)
    finished = {
        **tables,
        "fact_horizon_policy_metrics": metrics,
        "fact_policy_comparison": comparison,
        "fact_policy_pairwise_summary": pairwise,
    }
    return quality.union_reports(
        ex.source_violations(events, summary, POLICY),
        ex.dimension_conflicts(events),
        ex.policy_violations(metrics, comparison, pairwise, POLICY),
        ex.star_violations(finished),
    )


# ---- report queries ------------------------------------------------------------------------------

_MEASURES_SQL = {
    "Event Count": "count(*)",
    "Eligible Event Count": "count(*) FILTER (WHERE is_eligible_candidate)",
    "Reviewable Event Count": "count(*) FILTER (WHERE is_eligible_candidate)",
    "Not Reviewable Event Count": "count(*) FILTER (WHERE NOT is_eligible_candidate)",
    "Selected Event Count": "count(*) FILTER (WHERE selected_for_review)",
    "Chosen Event Count": "count(*) FILTER (WHERE selected_for_review)",
    "Actual Severe Event Count": "count(*) FILTER (WHERE actual_is_departure_severe_delay)",
    "Reviewable Severe Event Count": "count(*) FILTER (WHERE is_eligible_candidate AND actual_is_departure_severe_delay)",
    "Selected Severe Event Count": "count(*) FILTER (WHERE selected_for_review AND actual_is_departure_severe_delay)",
    "Chosen Severe Event Count": "count(*) FILTER (WHERE selected_for_review AND actual_is_departure_severe_delay)",
    "Average Predicted Severe Probability": "round(avg(predicted_severe_delay_probability) + 1e-9, 6)",
    "Average Predicted Risk": "round(avg(predicted_severe_delay_probability) + 1e-9, 6)",
    "Average Reviewable Predicted Risk": "round(avg(predicted_severe_delay_probability) FILTER (WHERE is_eligible_candidate) + 1e-9, 6)",
    "Scenario Selection Valid": "1",
    "Optimized at": "max(optimized_at)",
    "Optimized At Display": "max(optimized_at)",
}
_MEASURES_SQL["Stop events in this slice"] = _MEASURES_SQL["Event Count"]
_MEASURES_SQL["Stop events that became severe"] = _MEASURES_SQL["Actual Severe Event Count"]
_MEASURES_SQL["Stop events eligible for review"] = _MEASURES_SQL["Eligible Event Count"]


def _over(top: str, bottom: str) -> str:
    return f"round(({_MEASURES_SQL[top]}) / nullif({_MEASURES_SQL[bottom]}, 0) + 1e-9, 6)"


_MEASURES_SQL["Reviewable Share"] = _over("Eligible Event Count", "Event Count")
_MEASURES_SQL["Share of stop events eligible for review"] = _MEASURES_SQL["Reviewable Share"]
_MEASURES_SQL["Chosen Share Of Reviewable"] = _over("Chosen Event Count", "Eligible Event Count")
_MEASURES_SQL["Reviewable Severe Share"] = _over("Reviewable Severe Event Count", "Eligible Event Count")
_MEASURES_SQL["Among eligible stop events, share that became severe"] = _MEASURES_SQL["Reviewable Severe Share"]
_MEASURES_SQL["Chosen Severe Share"] = _over("Chosen Severe Event Count", "Chosen Event Count")
_MEASURES_SQL["Chosen Severe Capture"] = _over("Chosen Severe Event Count", "Reviewable Severe Event Count")
_LIFT = (
    f"round((({_MEASURES_SQL['Chosen Severe Event Count']}) / nullif({_MEASURES_SQL['Chosen Event Count']}, 0))"
    f" / nullif(({_MEASURES_SQL['Reviewable Severe Event Count']}) / nullif({_MEASURES_SQL['Eligible Event Count']}, 0), 0) + 1e-9, 6)"
)
_MEASURES_SQL["Chosen Lift Vs Reviewable Base"] = _LIFT

_HORIZON_SQL = {
    "Selected Events": "CAST(sum(selected_event_count) AS BIGINT)",
    "Eligible Events": "CAST(sum(eligible_candidate_count) AS BIGINT)",
    "Candidate Severe Events": "CAST(sum(actual_severe_candidate_count) AS BIGINT)",
    "Selected Severe Events": "CAST(sum(actual_severe_selected_count) AS BIGINT)",
    "Candidate Prevalence": "round(sum(actual_severe_candidate_count) / nullif(sum(eligible_candidate_count), 0) + 1e-9, 6)",
    "Precision at Capacity": "round(sum(actual_severe_selected_count) / nullif(sum(selected_event_count), 0) + 1e-9, 6)",
    "Severe-Delay Coverage": "round(sum(actual_severe_selected_count) / nullif(sum(actual_severe_candidate_count), 0) + 1e-9, 6)",
    "Selection Lift": """round((sum(actual_severe_selected_count) / nullif(sum(selected_event_count), 0))
        / nullif(sum(actual_severe_candidate_count) / nullif(sum(eligible_candidate_count), 0), 0) + 1e-9, 6)""",
    "Capacity Utilization": "round(sum(selected_event_count) / nullif(sum(selected_event_count + unused_capacity), 0) + 1e-9, 6)",
    "Review Slots": "CAST(sum(selected_event_count + unused_capacity) AS BIGINT)",
    "Unused Review Slots": "CAST(sum(unused_capacity) AS BIGINT)",
    "Available review slots left unused": "CAST(sum(unused_capacity) AS BIGINT)",
    "Share of available review slots that were used": (
        "round(sum(selected_event_count) / nullif(sum(selected_event_count + unused_capacity), 0) + 1e-9, 6)"
    ),
}


def _measured(table: str, axes: str, names, sql: dict[str, str], where: str = "", tail: str = "") -> str:
    listed = ", ".join(f'{sql[n]} AS "{n}"' for n in names)
    group = f" GROUP BY {axes}" if axes else ""
    lead = f"{axes}, " if axes else ""
    return recursive(*STAR, final=f"SELECT {lead}{listed} FROM {table} {where}{group} {tail}")


def _event_report(name, axes, measures, where="", slicers=()):
    def build(spark, folder):
        fact = exported(spark, folder)["fact_event_decision"]
        chosen = report.some(report.event_measures(), *measures)
        return report.report(fact, [a.strip('"') for a in axes], chosen, list(slicers))

    query(name, _measured("event_fact", ", ".join(axes), measures, _MEASURES_SQL, where))(build)


_ALL = list(_MEASURES_SQL)
_event_report("event_measures_by_hour", ["hour_of_day"], _ALL)
_event_report(
    "event_measures_sliced",
    [],
    _ALL,
    "WHERE calendar_date >= '2024-01-20' AND hour_of_day BETWEEN 6 AND 18",
    ["calendar_date >= '2024-01-20'", "hour_of_day BETWEEN 6 AND 18"],
)
_event_report(
    "risk_band_mix", ['"Predicted Risk Band"', '"Predicted Risk Band Sort"', '"Review Eligibility"'], ["Event Count"]
)
_event_report(
    "risk_band_outcomes", ['"Predicted Risk Band"', '"Predicted Risk Band Sort"', '"Actual Outcome"'], ["Event Count"]
)
_event_report(
    "risk_band_decisions",
    ['"Predicted Risk Band"', '"Review Decision"'],
    ["Event Count"],
    "WHERE is_eligible_candidate",
    ["is_eligible_candidate"],
)
_event_report("events_by_outcome", ['"Actual Outcome"'], ["Event Count"])
_event_report("risk_by_train_type", ["train_type"], ["Average Reviewable Predicted Risk", "Actual Severe Event Count"])
_event_report(
    "type_class_risk",
    ["train_type", "service_class"],
    ["Reviewable Event Count", "Average Reviewable Predicted Risk", "Reviewable Severe Share"],
)
_event_report(
    "type_class_table",
    ["train_type", "service_class"],
    [
        "Event Count",
        "Actual Severe Event Count",
        "Chosen Severe Share",
        "Average Predicted Severe Probability",
    ],
)


def _horizon_report(name, axes, where="", slicers=()):
    def build(spark, folder):
        fact = exported(spark, folder)["fact_horizon_summary"]
        return report.report(fact, list(axes), report.horizon_measures(), list(slicers))

    query(name, _measured("horizon_fact", ", ".join(axes), list(_HORIZON_SQL), _HORIZON_SQL, where))(build)


_horizon_report("horizon_measures_by_hour", ["hour_of_day"])
_horizon_report("horizon_measures_sliced", [], "WHERE hour_of_day >= 12", ["hour_of_day >= 12"])


@query(
    "scenario_strip",
    recursive(
        *STAR,
        final=f"""SELECT '{_SCENARIO_NAME}' AS "Scenario Display", '{MODEL[1]}' AS "Model Version Display",
        '{VERSION}' AS "Policy Version Display", max(optimized_at) AS "Optimized at",
        max(optimized_at) AS "Optimized At Display" FROM event_fact""",
    ),
)
def scenario_strip(spark, folder):
    tables = exported(spark, folder)
    joined = report.with_dimension(tables["fact_event_decision"], tables["dim_scenario"], "scenario_key")
    shown = {
        **report.scenario_measures(),
        **report.some(report.event_measures(), "Optimized at", "Optimized At Display"),
    }
    return report.report(joined, [], shown)


@query(
    "top_stations",
    recursive(
        *STAR,
        final="""SELECT station_name, count(*) AS "Event Count" FROM event_fact GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
)
def top_stations(spark, folder):
    return report.top_stations(exported(spark, folder)["fact_event_decision"])


@query(
    "top_risk_20",
    recursive(
        *STAR,
        final=printed(
            """SELECT calendar_date, hour_of_day, station_name, train_type, line_number, "Predicted Risk Band",
            predicted_severe_delay_probability, "Actual Outcome", stop_event_key, CAST(dense_rank() OVER
              (ORDER BY predicted_severe_delay_probability DESC) AS INTEGER) AS risk_rank
            FROM event_fact WHERE is_eligible_candidate
            ORDER BY predicted_severe_delay_probability DESC, stop_event_key LIMIT 20""",
            doubles="predicted_severe_delay_probability",
        ),
    ),
)
def top_risk_20(spark, folder):
    columns = [
        "calendar_date",
        "hour_of_day",
        "station_name",
        "train_type",
        "line_number",
        "Predicted Risk Band",
        "predicted_severe_delay_probability",
        "Actual Outcome",
        "stop_event_key",
        "risk_rank",
    ]
    return report.riskiest_events(exported(spark, folder)["fact_event_decision"]).select(*columns)


@query(
    "risk_ranks",
    recursive(
        *STAR,
        final="""SELECT stop_event_key, dense_rank() OVER (ORDER BY predicted_severe_delay_probability DESC) AS risk_rank
        FROM event_fact WHERE is_eligible_candidate""",
    ),
)
def risk_ranks(spark, folder):
    ranked = report.risk_ranks(exported(spark, folder)["fact_event_decision"])
    return ranked.select("stop_event_key", "risk_rank")


@query(
    "review_queue",
    recursive(
        *STAR,
        final=printed(
            """SELECT calendar_date, hour_of_day, selection_rank, station_name, train_type, line_number,
            predicted_severe_delay_probability, "Actual Outcome", priority_score, stop_event_key
            FROM event_fact WHERE selected_for_review""",
            doubles="predicted_severe_delay_probability priority_score",
        ),
    ),
)
def review_queue(spark, folder):
    return report.review_queue(exported(spark, folder)["fact_event_decision"])


@query(
    "date_hour_matrix",
    recursive(
        *STAR,
        final="SELECT calendar_date, "
        + ", ".join(f"count(*) FILTER (WHERE hour_of_day = {h}) AS h{h:02d}" for h in range(24))
        + " FROM event_fact GROUP BY 1",
    ),
)
def date_hour_matrix(spark, folder):
    return report.date_hour_matrix(exported(spark, folder)["fact_event_decision"])


@query(
    "slots_by_hour",
    recursive(
        *STAR,
        """slots AS (SELECT hour_of_day, CAST(sum(selected_event_count + unused_capacity) AS BIGINT) AS a,
             CAST(sum(unused_capacity) AS BIGINT) AS b FROM horizon_fact GROUP BY 1),
           ice AS (SELECT hour_of_day, count(*) FILTER (WHERE selected_for_review) AS n FROM event_fact
             WHERE train_type = 'ICE' GROUP BY 1)""",
        final="""SELECT hour_of_day, a AS "Review Slots", b AS "Unused Review Slots",
        coalesce(n, 0) AS "Chosen Event Count" FROM slots LEFT JOIN ice USING (hour_of_day)""",
    ),
)
def slots_by_hour(spark, folder):
    """Review slots stay whole while a train slicer narrows the events."""
    tables = exported(spark, folder)
    return report.slots_and_events_by_hour(
        tables["fact_event_decision"], tables["fact_horizon_summary"], [F.col("train_type") == "ICE"]
    )
