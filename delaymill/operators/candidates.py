"""Review candidates: eligibility, duplicates, hourly horizons and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.config import SPLIT_OF_MODE, Policy
from delaymill.functions.delays import share
from delaymill.operators.ranking import rank_rows
from delaymill.operators.split import require_columns
from delaymill.session import spool

PROBABILITY = "predicted_severe_delay_probability"
LEGACY_PROBABILITY = "predicted_probability"
OUTCOME = "actual_is_departure_severe_delay"
HORIZON = ["execution_mode", "horizon_id"]

# Columns scored rows must carry, and those they may lack.
REQUIRED_FIELDS = (
    "stop_event_key",
    "journey_id",
    "service_date",
    "station_id",
    "train_type",
    "line_number",
    "prediction_split",
    "hour_of_day",
    "model_name",
    "model_version",
    "selected_threshold",
    OUTCOME,
)
OPTIONAL_FIELDS = {
    "station_name": "string",
    "train_service_key": "string",
    "service_class": "string",
}

# Eligibility reasons.
ELIGIBLE = "eligible"
BELOW_THRESHOLD = "below_minimum_candidate_probability"
INVALID_PROBABILITY = "invalid_probability"
MISSING_FIELD = "missing_required_field"
DUPLICATE_KEY = "duplicate_stop_event_key"


def normalized_scores(scored: DataFrame) -> DataFrame:
    """Canonical probability column, optional columns present, required columns checked."""
    if PROBABILITY not in scored.columns:
        require_columns(scored, [LEGACY_PROBABILITY], "scored rows")
        scored = scored.withColumnRenamed(LEGACY_PROBABILITY, PROBABILITY)
    absent = {c: F.lit(None).cast(t) for c, t in OPTIONAL_FIELDS.items() if c not in scored.columns}
    scored = scored.withColumns(absent) if absent else scored
    require_columns(scored, REQUIRED_FIELDS, "scored rows")
    return scored


def horizon_id(day, hour):
    return F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), hour.cast("string"))


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """Event keys that occur more than once in a mode; stored, because normally there are few or none."""
    counted = rows.groupBy("execution_mode", F.col("stop_event_key")).agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.filter("n > 1").select(
        F.col("execution_mode").alias("_mode"), F.col("stop_event_key").alias("_key"), F.lit(True).alias("_repeated")
    )
    return spool(repeated, "repeated_keys")


def prepare_candidates(scored: DataFrame, policy: Policy, modes: tuple[str, ...] = tuple(SPLIT_OF_MODE)) -> DataFrame:
    """Candidates of one or more execution modes with their eligibility and horizon."""
    split = F.col("prediction_split")
    rows = normalized_scores(scored).filter(split.isin(*[SPLIT_OF_MODE[name] for name in modes]))
    mode = F.lit(None).cast("string")
    for name in modes:
        mode = F.when(split == SPLIT_OF_MODE[name], name).otherwise(mode)
    rows = rows.withColumn("execution_mode", mode)
    repeated = _repeated_keys(rows)
    same = (F.col("execution_mode") == F.col("_mode")) & F.col("stop_event_key").eqNullSafe(F.col("_key"))
    rows = rows.join(repeated, same, "left")

    p = F.col(PROBABILITY)
    incomplete = F.lit(False)
    for c in ("stop_event_key", "journey_id", "station_id", "hour_of_day"):
        incomplete = incomplete | F.col(c).isNull()
    reason = (
        F.when(F.col("_repeated"), DUPLICATE_KEY)
        .when(p.isNull() | F.isnan(p) | ~p.between(0, 1), INVALID_PROBABILITY)
        .when(p < policy.threshold, BELOW_THRESHOLD)
        .when(incomplete, MISSING_FIELD)
        .otherwise(ELIGIBLE)
    )
    day = F.to_date("service_date")
    prepared = rows.withColumns({
        "station_id": F.col("station_id").cast("string"),
        "hour_of_day": F.col("hour_of_day").cast("int"),
        "selected_threshold": F.lit(float(policy.selected_threshold)),
        "predicted_is_departure_severe_delay": F.coalesce(p >= policy.selected_threshold, F.lit(False)),
        "calendar_date": F.date_format(day, "yyyy-MM-dd"),
        "horizon_id": horizon_id(day, F.col("hour_of_day")),
        "minimum_candidate_probability": F.lit(float(policy.threshold)),
        "optimization_run_id": F.concat_ws("-", "execution_mode", F.lit(policy.run_id)),
        "optimized_at": F.lit(policy.optimized_at),
        "priority_score": p,
        "preferred_station_load_per_station_hour": F.lit(policy.preferred_station_load),
        "frozen_station_excess_penalty_lambda": F.lit(float(policy.station_penalty)),
        "eligibility_reason": reason,
    })
    return prepared.withColumn("is_eligible_candidate", F.col("eligibility_reason") == ELIGIBLE).drop(
        "_mode", "_key", "_repeated"
    )


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Priority of every candidate in its horizon: likely first, key order on ties, unknown last."""
    order = [F.desc_nulls_last(PROBABILITY), F.asc_nulls_last("stop_event_key")]
    return rank_rows(candidates, HORIZON, order, "candidate_priority_rank")


def horizon_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate statistics per horizon, reduced per station and per journey before per horizon."""
    eligible = F.col("is_eligible_candidate")
    stations = candidates.groupBy(*HORIZON, "calendar_date", "hour_of_day", "station_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(eligible).alias("open"),
        F.count_if(eligible & F.col(OUTCOME)).alias("severe"),
    )
    per_horizon = stations.groupBy(*HORIZON).agg(
        F.min("calendar_date").alias("calendar_date"),
        F.min("hour_of_day").alias("hour_of_day"),
        F.sum("n").alias("candidate_count"),
        F.sum("open").alias("eligible_candidate_count"),
        F.sum("severe").alias("actual_severe_candidate_count"),
        F.count_if(F.col("open") > 0).alias("distinct_eligible_station_count"),
        F.max("open").alias("max_candidate_count_at_one_station"),
    )
    journeys = (
        candidates.filter(eligible)
        .select(*HORIZON, "journey_id")
        .distinct()
        .groupBy(*HORIZON)
        .agg(F.count(F.lit(1)).alias("distinct_eligible_journey_count"))
    )
    return per_horizon.join(journeys, HORIZON, "left").withColumn(
        "distinct_eligible_journey_count", F.coalesce("distinct_eligible_journey_count", F.lit(0).cast("long"))
    )


def opportunity(horizons: DataFrame, capacity: int) -> DataFrame:
    """Where a capacity binds and where several candidates compete at one station."""
    target = F.least(F.lit(capacity), F.col("distinct_eligible_journey_count")).cast("int")
    return horizons.select(
        "execution_mode",
        "calendar_date",
        "hour_of_day",
        "horizon_id",
        F.lit(capacity).alias("capacity_per_hour"),
        F.col("eligible_candidate_count").alias("eligible_event_count"),
        "distinct_eligible_journey_count",
        "distinct_eligible_station_count",
        "max_candidate_count_at_one_station",
        target.alias("feasible_selection_target"),
        (F.col("max_candidate_count_at_one_station") > 1).alias("station_excess_could_activate"),
        (target == capacity).alias("capacity_binds"),
    )


def candidate_violations(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Modes without rows, and rows of another model version than the policy's."""
    per_mode = candidates.groupBy("execution_mode").agg(
        F.count_if(~F.col("model_version").eqNullSafe(F.lit(policy.scoring_model_version))).alias("foreign_model_rows"),
        share(F.count_if(F.col("is_eligible_candidate")), F.count(F.lit(1))).alias("eligible_share"),
    )
    return per_mode
