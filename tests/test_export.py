"""Report tables from literal rows, and the rejections."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from delaymill.config import EXACT, Policy, SearchConfig
from delaymill.operators import export as ex
from delaymill.operators import quality

POLICY = Policy(
    selected_threshold=0.4,
    scoring_model_name="logistic_regression",
    scoring_model_version="2026-06-28-v1",
    preferred_station_load=1,
    station_penalty=0.2,
    search=SearchConfig(optimization_policy_version="2026-06-28-v1"),
    frozen_at="2026-06-28T10:26:49+00:00",
)
EVENTS = [
    ("A", "J1", "S1", "Berlin Hbf", "ICE", "10", "1001", "long", None, 8, True, True, 0.9, 1, 1),
    ("B", "J2", "S1", "Berlin Hbf", "ICE", "10", "1002", "long", "long", 8, False, False, 0.5, 2, None),
    ("C", "J3", "S2", None, None, None, "1003", "regional", None, 9, True, False, 0.4, 1, 1),
]
EVENT_KIND = (
    "stop_event_key string, journey_id string, station_id string, station_name string, train_type string, "
    "line_number string, train_service_key string, service_class_x string, service_class_y string, hour_of_day int, "
    "selected_for_review boolean, actual_is_departure_severe_delay boolean, "
    "predicted_severe_delay_probability double, candidate_priority_rank long, selection_rank int"
)
HORIZONS = [
    ("2025-03-19|8", 8, 2, 2, 1, 2, 0.9, 1, 1, 0.5, 1.0, 1.0, 2.0),
    ("2025-03-19|9", 9, 1, 1, 1, 2, 0.4, 0, 0, 0.0, 0.0, None, None),
]
HORIZON_KIND = (
    "horizon_id string, hour_of_day int, candidate_count long, eligible_candidate_count long, "
    "selected_event_count long, unused_capacity int, selected_probability_score_sum double, "
    "actual_severe_selected_count long, actual_severe_candidate_count long, candidate_prevalence double, "
    "precision_at_capacity double, severe_delay_coverage double, lift_over_candidate_prevalence double"
)


def run_columns():
    return {
        "optimization_run_id": F.lit("run-1"),
        "execution_mode": F.lit("final"),
        "calendar_date": F.lit("2025-03-19"),
        "capacity_scenario": F.lit("hourly_capacity_3"),
        "capacity_per_hour": F.lit(3),
        "model_name": F.lit("logistic_regression"),
        "model_version": F.lit("2026-06-28-v1"),
        "optimized_at": F.lit("2026-06-28T12:26:49+00:00"),
        "solver_status": F.lit(2),
    }


@pytest.fixture()
def decisions(spark):
    p = F.col("predicted_severe_delay_probability")
    return spark.createDataFrame(EVENTS, EVENT_KIND).withColumns({
        **run_columns(),
        "prediction_split": F.lit("test"),
        "horizon_id": F.concat(F.lit("2025-03-19|"), F.col("hour_of_day").cast("string")),
        "minimum_candidate_probability": F.lit(0.4),
        "selected_threshold": F.lit(0.4),
        "is_eligible_candidate": F.lit(True),
        "eligibility_reason": F.lit("eligible"),
        "objective_contribution": p,
        "priority_score": p,
    })


@pytest.fixture()
def summary(spark):
    return spark.createDataFrame(HORIZONS, HORIZON_KIND).withColumns(run_columns())


def test_star_tables(spark, decisions, summary):
    events = ex.normalized_events(decisions, POLICY)
    quality.assert_clean(ex.source_violations(events, summary, POLICY, 2))
    quality.assert_clean(ex.dimension_conflicts(events))
    tables = ex.star_tables(spark, events, summary, POLICY)
    quality.assert_clean(ex.star_violations(tables))
    quality.assert_clean(ex.reconciliation(tables["fact_event_decision"], tables["fact_horizon_summary"]))
    facts = {r.stop_event_key: r for r in tables["fact_event_decision"].collect()}
    assert facts["C"].station_name == "Unknown station"
    assert facts["C"].train_type == "Unknown" and facts["C"].line_number == "Not provided in source"
    assert facts["A"].service_class == "long" and facts["C"].service_class == "regional"
    assert facts["B"]["Review Decision"] == "Not chosen for review"
    assert facts["B"]["Actual Outcome"] == "Did not become severe"
    hours = [r.hour_label for r in tables["dim_date_hour"].orderBy("hour_of_day").collect()]
    assert hours == ["08:00-08:59", "09:00-09:59"]
    name = tables["dim_scenario"].first().scenario_display_name
    assert name == "Prototype hourly_capacity_3 | threshold 0.40 | policy 2026-06-28-v1"


def test_names_are_looked_up(spark, decisions):
    names = spark.createDataFrame([("S2", "Kassel")], "station_id string, _name string")
    rows = {r.stop_event_key: r.station_name for r in ex.normalized_events(decisions, POLICY, names).collect()}
    assert rows == {"A": "Berlin Hbf", "B": "Berlin Hbf", "C": "Kassel"}


def test_conflicting_station_names_are_rejected(decisions):
    renamed = F.when(F.col("stop_event_key") == "B", "BERLIN HBF").otherwise(F.col("station_name"))
    events = ex.normalized_events(decisions.withColumn("station_name", renamed), POLICY)
    with pytest.raises(ValueError, match="station fixes its name"):
        quality.assert_clean(ex.dimension_conflicts(events))


def test_drift_between_events_and_horizons_is_rejected(decisions, summary):
    drifted = summary.withColumn(
        "selected_event_count", F.when(F.col("hour_of_day") == 8, 2).otherwise(F.col("selected_event_count"))
    )
    with pytest.raises(ValueError, match="selected_event_count"):
        quality.assert_clean(ex.reconciliation(ex.normalized_events(decisions, POLICY), drifted))
    with pytest.raises(ValueError, match="candidate_count"):
        missing = summary.filter("hour_of_day = 9")
        quality.assert_clean(ex.reconciliation(ex.normalized_events(decisions, POLICY), missing))


def test_foreign_runs_are_rejected(decisions, summary):
    with pytest.raises(ValueError, match="one run in all tables"):
        other = summary.withColumn("optimization_run_id", F.lit("run-2"))
        quality.assert_clean(ex.source_violations(ex.normalized_events(decisions, POLICY), other, POLICY))


def test_contract_rejects_ranges_and_columns(decisions, summary):
    fact = ex.fact_horizon_summary(summary.withColumn("precision_at_capacity", F.lit(1.5)), POLICY)
    with pytest.raises(ValueError, match="precision_at_capacity out of range"):
        quality.assert_clean(
            quality.contract_violations(fact, ex.CONTRACTS["fact_horizon_summary"], "fact_horizon_summary")
        )
    with pytest.raises(ValueError, match="do not match"):
        quality.contract_violations(fact.drop("hour_of_day"), ex.CONTRACTS["fact_horizon_summary"], "horizons")


def test_fingerprint_keeps_nulls(spark):
    rows = [("final", 3, "2025-03-19|8", 2, 2, 2, None), ("final", 3, "2025-03-19|10", 1, 1, 1, 0)]
    kind = (
        "execution_mode string, capacity_per_hour int, horizon_id string, candidate_count long, "
        "eligible_candidate_count long, feasible_selection_target int, actual_severe_candidate_count long"
    )
    names = ["horizon_id", "candidate_count", "eligible_candidate_count", "feasible_selection_target",
             "actual_severe_candidate_count"]
    text = json.dumps([dict(zip(names, r[2:])) for r in sorted(rows, key=lambda r: r[2])], separators=(",", ":"))
    found = ex.pool_fingerprints(spark.createDataFrame(rows, kind)).first().candidate_pool_fingerprint
    assert found == hashlib.sha256(text.encode()).hexdigest()


def test_unknown_policy_is_an_error(spark):
    from delaymill.functions import labels

    with pytest.raises(Exception, match="unknown policy"):
        spark.range(1).select(labels.policy_display_name(F.lit("other"))).collect()
    assert spark.range(1).select(labels.policy_display_name(F.lit(EXACT)).alias("n")).first().n == "Exact"
