"""What the choices of each policy achieve: per horizon, per policy, pairwise, and over the search grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.config import DIRECT, GREEDY, RANDOM, SOLVED, STOPPED, Policy
from delaymill.functions.delays import share
from delaymill.operators.candidates import HORIZON, PROBABILITY


def pick_statistics(picks: Column, preferred: Column) -> dict[str, Column]:
    """Statistics of one choice; at most as many elements as the capacity."""
    stations = picks.getField("station_id")
    loads = F.transform(
        F.array_distinct(stations), lambda s: F.size(F.filter(stations, lambda other: other == s))
    )
    excess = F.transform(loads, lambda n: F.greatest(n - preferred, F.lit(0)).cast("double"))
    keys = F.array_sort(picks.getField("stop_event_key"))
    return {
        "selected_event_count": F.size(picks).cast("long"),
        "selected_probability_score_sum": F.aggregate(picks, F.lit(0.0), lambda a, x: a + x.getField("p")),
        "actual_severe_selected_count": F.size(F.filter(picks, lambda x: x.getField("severe"))).cast("long"),
        "distinct_selected_stations": F.size(loads).cast("long"),
        "max_selected_same_station_in_horizon": F.coalesce(F.array_max(loads), F.lit(0)).cast("long"),
        "station_concentration_excess_total": F.aggregate(excess, F.lit(0.0), lambda a, x: a + x),
        "selected_keys": keys,
    }


def key_set_hash(keys: Column) -> Column:
    return F.sha2(F.array_join(keys, "|"), 256)


def _with_all_horizons(horizons: DataFrame, chosen: DataFrame, options: list[Column]) -> DataFrame:
    """Choices of every horizon, also of those with nothing to choose from."""
    grid = horizons.select("*", F.inline(F.array(*options)))
    keys = [c for c in chosen.columns if c not in ("picks", "solver_status")]
    none = F.array().cast(chosen.schema["picks"].dataType)
    return grid.join(chosen, keys, "left").withColumn("picks", F.coalesce("picks", none))


def horizon_outcomes(
    horizons: DataFrame, chosen: DataFrame, policy: Policy, capacities: tuple[int, ...] | None = None
) -> DataFrame:
    """Everything known about each horizon under each policy and capacity, with the hash of the chosen keys."""
    search = policy.search
    options = [
        F.struct(F.lit(name).alias("policy_name"), F.lit(c).alias("capacity_per_hour"))
        for name in search.policy_names
        for c in capacities or search.scenario_capacities
    ]
    rows = _with_all_horizons(horizons, chosen, options)
    preferred = F.lit(policy.preferred_station_load)
    rows = rows.withColumns(pick_statistics(F.col("picks"), preferred))
    capacity, selected = F.col("capacity_per_hour"), F.col("selected_event_count")
    eligible, severe = F.col("eligible_candidate_count"), F.col("actual_severe_candidate_count")
    target = F.least(capacity, F.col("distinct_eligible_journey_count")).cast("int")
    exact = F.col("policy_name") == search.optimization_policy_name
    rows = rows.withColumns({
        "optimization_run_id": F.concat_ws("-", "execution_mode", F.lit(policy.run_id)),
        "capacity_scenario": F.concat(F.lit("hourly_capacity_"), capacity.cast("string")),
        "feasible_selection_target": target,
        "candidate_shortage_count": capacity - target,
        "unused_capacity": (capacity - selected).cast("int"),
        "selected_severe_event_count": F.col("actual_severe_selected_count"),
        "candidate_prevalence": share(severe, eligible),
        "precision_at_capacity": share(F.col("actual_severe_selected_count"), selected),
        "severe_delay_coverage": share(F.col("actual_severe_selected_count"), severe),
        "penalty_active_in_horizon": F.col("station_concentration_excess_total") > 0,
        "solver_status": F.coalesce("solver_status", F.when(exact, SOLVED).otherwise(DIRECT)),  # nothing to choose is optimal
        "scoring_model_name": F.lit(policy.scoring_model_name),
        "scoring_model_version": F.lit(policy.scoring_model_version),
        "optimization_policy_name": F.lit(search.optimization_policy_name),
        "optimization_policy_version": F.lit(search.optimization_policy_version),
        "preferred_station_load_per_station_hour": preferred,
        "frozen_station_excess_penalty_lambda": F.lit(float(policy.station_penalty)),
        "optimized_at": F.lit(policy.optimized_at),
        "selected_stop_event_key_hash": key_set_hash(F.col("selected_keys")),
    })
    lift = F.try_divide("precision_at_capacity", "candidate_prevalence")
    return rows.withColumn("lift_over_candidate_prevalence", lift)


# Columns of a horizon summary, in order.
SUMMARY_COLUMNS = (
    "optimization_run_id",
    "execution_mode",
    "policy_name",
    "calendar_date",
    "hour_of_day",
    "horizon_id",
    "capacity_scenario",
    "capacity_per_hour",
    "feasible_selection_target",
    "candidate_count",
    "eligible_candidate_count",
    "selected_event_count",
    "candidate_shortage_count",
    "unused_capacity",
    "selected_probability_score_sum",
    "actual_severe_selected_count",
    "selected_severe_event_count",
    "actual_severe_candidate_count",
    "candidate_prevalence",
    "precision_at_capacity",
    "severe_delay_coverage",
    "lift_over_candidate_prevalence",
    "distinct_selected_stations",
    "max_selected_same_station_in_horizon",
    "station_concentration_excess_total",
    "penalty_active_in_horizon",
    "solver_status",
    "scoring_model_name",
    "scoring_model_version",
    "optimization_policy_name",
    "optimization_policy_version",
    "preferred_station_load_per_station_hour",
    "frozen_station_excess_penalty_lambda",
    "optimized_at",
)


def horizon_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(*SUMMARY_COLUMNS)


def horizon_policy_metrics(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(*SUMMARY_COLUMNS, "selected_stop_event_key_hash")


def objective_totals(outcomes: DataFrame, policy: Policy) -> DataFrame:
    """Total objective per policy and capacity; only the penalised policies pay for station excess."""
    penalised = F.col("policy_name").isin(GREEDY, policy.search.optimization_policy_name)
    paid = F.when(penalised, F.col("station_concentration_excess_total")).otherwise(0.0)
    return outcomes.groupBy("execution_mode", "policy_name", "capacity_per_hour").agg(
        F.sum(F.col("selected_probability_score_sum") - paid * policy.station_penalty).alias("solver_objective_value")
    )


def policy_comparison(outcomes: DataFrame) -> DataFrame:
    keys = ["execution_mode", "policy_name", "capacity_scenario", "capacity_per_hour"]
    binding = F.col("feasible_selection_target") == F.col("capacity_per_hour")
    short = F.col("candidate_shortage_count") > 0
    horizons = F.count(F.lit(1))
    selected, hit = F.sum("selected_event_count"), F.sum("actual_severe_selected_count")
    totals = outcomes.groupBy(*keys).agg(
        selected.alias("selected_event_count"),
        hit.alias("selected_severe_event_count"),
        share(hit, selected).alias("precision_at_capacity"),
        share(hit, F.sum("actual_severe_candidate_count")).alias("severe_delay_coverage"),
        F.sum("selected_probability_score_sum").alias("expected_risk_score_captured"),
        F.max("max_selected_same_station_in_horizon").alias("max_selected_same_station_in_horizon"),
        F.sum("station_concentration_excess_total").alias("station_concentration_excess_total"),
        F.sum("unused_capacity").alias("unused_capacity_total"),
        F.count_if(binding).alias("binding_horizon_count"),
        share(F.count_if(binding), horizons).alias("binding_horizon_rate"),
        F.count_if(short).alias("candidate_shortage_horizon_count"),
        share(F.count_if(short), horizons).alias("candidate_shortage_horizon_rate"),
        F.percentile("feasible_selection_target", 0.5).alias("median_feasible_selection_target"),
        F.first("preferred_station_load_per_station_hour").alias("preferred_station_load_per_station_hour"),
        F.first("frozen_station_excess_penalty_lambda").alias("frozen_station_excess_penalty_lambda"),
    )
    stations = (
        outcomes.select(*keys, F.explode("picks.station_id").alias("station_id"))
        .groupBy(*keys)
        .agg(F.count_distinct("station_id").alias("distinct_stations_covered"))
    )
    drawn = F.when(F.col("policy_name") == RANDOM, F.col("precision_at_capacity"))
    baseline = F.max(drawn).over(Window.partitionBy("execution_mode", "capacity_per_hour"))
    return totals.join(stations, keys, "left").withColumns({
        "distinct_stations_covered": F.coalesce("distinct_stations_covered", F.lit(0).cast("long")),
        "lift_vs_random": F.try_divide("precision_at_capacity", baseline),
    })


def _set_overlap(left: Column, right: Column) -> dict[str, Column]:
    union = F.size(F.array_union(left, right))
    common = F.size(F.array_intersect(left, right))
    return {
        "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(common / union),
        "disagreement": (union - common).cast("long"),
    }


def pairwise_diagnostics(outcomes: DataFrame, reference: str, candidate: str, capacity: int) -> DataFrame:
    """How far the choices of two policies agree, per execution mode."""
    at_capacity = outcomes.filter(F.col("capacity_per_hour") == capacity)
    left = at_capacity.filter(F.col("policy_name") == reference).select(*HORIZON, F.col("selected_keys").alias("left"))
    right = at_capacity.filter(F.col("policy_name") == candidate).select(
        *HORIZON, F.col("selected_keys").alias("right"), "penalty_active_in_horizon"
    )
    pairs = left.join(right, HORIZON).withColumns(_set_overlap(F.col("left"), F.col("right")))
    same = F.count_if(F.col("disagreement") == 0)
    return pairs.groupBy("execution_mode").agg(
        F.count(F.lit(1)).alias("horizon_count"),
        same.alias("matching_horizon_count"),
        F.count_if(F.col("disagreement") > 0).alias("differing_horizon_count"),
        share(same, F.count(F.lit(1))).alias("selected_set_match_rate"),
        F.avg("jaccard").alias("mean_selected_set_jaccard"),
        F.sum("disagreement").alias("selected_event_disagreement_count"),
        F.count_if("penalty_active_in_horizon").alias("penalty_active_horizon_count"),
    )


def tuning_results(horizons: DataFrame, searched: DataFrame, policy: Policy) -> DataFrame:
    """Quality of every searched (load, penalty), and how far it departs from no penalty."""
    search = policy.search
    point = ["preferred_station_load_per_station_hour", "station_excess_penalty_lambda"]
    zero = F.col("station_excess_penalty_lambda") == search.diagnostic_station_excess_penalty_lambda
    load = F.col("preferred_station_load_per_station_hour")
    rows = searched.withColumns(pick_statistics(F.col("picks"), load))
    per_load = Window.partitionBy(*HORIZON, "preferred_station_load_per_station_hour")
    rows = rows.withColumn("_free", F.max(F.when(zero, F.col("selected_keys"))).over(per_load))
    totals = horizons.groupBy("execution_mode").agg(
        F.sum("actual_severe_candidate_count").alias("total_actual_severe_candidate_count"),
        F.count(F.lit(1)).alias("_horizons"),
    )
    per_point = rows.groupBy("execution_mode", *point).agg(
        F.sum("actual_severe_selected_count").alias("selected_severe_event_count"),
        F.sum("station_concentration_excess_total").alias("station_concentration_excess_total"),
        F.count_if(F.col("selected_keys") != F.col("_free")).alias("differing_horizon_count_vs_zero_penalty"),
        F.when(F.count_if(F.col("solver_status") != SOLVED) > 0, STOPPED).otherwise(SOLVED).alias("solver_status"),
    )
    stations = (
        rows.select("execution_mode", *point, F.explode("picks.station_id").alias("station_id"))
        .groupBy("execution_mode", *point)
        .agg(F.count_distinct("station_id").alias("distinct_stations_covered"))
    )
    joined = per_point.join(stations, ["execution_mode", *point], "left").join(totals, "execution_mode")
    differing = F.col("differing_horizon_count_vs_zero_penalty")
    return joined.select(
        "execution_mode",
        *point,
        zero.alias("is_diagnostic_zero_penalty"),
        "solver_status",
        "selected_severe_event_count",
        "total_actual_severe_candidate_count",
        share(F.col("selected_severe_event_count"), F.col("total_actual_severe_candidate_count")).alias(
            "severe_delay_coverage"
        ),
        "station_concentration_excess_total",
        F.coalesce("distinct_stations_covered", F.lit(0).cast("long")).alias("distinct_stations_covered"),
        (F.col("_horizons") - differing).alias("matching_horizon_count_vs_zero_penalty"),
        "differing_horizon_count_vs_zero_penalty",
    )


def tuning_winner(tuning: DataFrame) -> DataFrame:
    return (
        tuning.filter(~F.col("is_diagnostic_zero_penalty"))
        .orderBy(
            F.desc("selected_severe_event_count"),
            F.desc_nulls_last("severe_delay_coverage"),
            F.asc("station_concentration_excess_total"),
            F.desc("distinct_stations_covered"),
            F.asc("station_excess_penalty_lambda"),
            F.asc("preferred_station_load_per_station_hour"),
        )
        .limit(1)
    )


def disallowed_statuses(outcomes: DataFrame, policy: Policy) -> DataFrame:
    """Solver statuses of the exact policy that the search configuration does not allow, and how many choices have them."""
    search = policy.search
    allowed = F.when(
        F.col("execution_mode") == "development",
        F.col("solver_status").isin(*search.development_allowed_solver_statuses),
    ).otherwise(F.col("solver_status").isin(*search.final_allowed_solver_statuses))
    exact = outcomes.filter(F.col("policy_name") == search.optimization_policy_name)
    return exact.filter(~allowed).groupBy("execution_mode", "solver_status").agg(F.count(F.lit(1)).alias("choice_count"))


def event_decisions(
    ranked: DataFrame, outcomes: DataFrame, policy: Policy, policy_name: str, capacity: int
) -> DataFrame:
    """All candidates with the decision of one policy at one capacity.

    Everything the rows need is one row per horizon, so a single join suffices.
    """
    wanted = (F.col("policy_name") == policy_name) & (F.col("capacity_per_hour") == capacity)
    own = ["policy_name", "capacity_per_hour", "capacity_scenario", "feasible_selection_target"]
    chosen = outcomes.filter(wanted).select(
        *HORIZON, *own, "solver_status", F.col("picks.stop_event_key").alias("_keys")
    )
    totals = objective_totals(outcomes.filter(wanted), policy).select("execution_mode", "solver_objective_value")
    rows = ranked.join(chosen, HORIZON, "left").join(F.broadcast(totals), "execution_mode", "left")
    place = F.when(F.col("is_eligible_candidate"), F.array_position("_keys", F.col("stop_event_key")))
    rows = rows.withColumn("_place", F.coalesce(place, F.lit(0)))
    selected = F.col("_place") > 0
    return rows.withColumns({
        "optimization_policy_name": F.lit(policy.search.optimization_policy_name),
        "optimization_policy_version": F.lit(policy.search.optimization_policy_version),
        "scoring_model_name": F.col("model_name"),
        "scoring_model_version": F.col("model_version"),
        "selected_for_review": selected,
        "objective_contribution": F.when(selected, F.col(PROBABILITY)).otherwise(0.0),
        "selection_rank": F.when(selected, F.col("_place")).cast("int"),
    }).drop("_keys", "_place")
