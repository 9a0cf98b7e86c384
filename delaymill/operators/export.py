"""The report's star schema: facts and dimensions with their contracts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.config import EXACT, Policy
from delaymill.functions import labels
from delaymill.functions.calendar import hour_label
from delaymill.functions.delays import share
from delaymill.operators import quality
from delaymill.operators.candidates import OUTCOME, PROBABILITY
from delaymill.operators.outcomes import SUMMARY_COLUMNS

BIN = "predicted_severe_delay_probability (bins)"
FINAL, TEST_SPLIT = "final", "test"

_UNIT = (0.0, 1.0)


def _contract(names: list[str], optional: tuple[str, ...] = (), unit: tuple[str, ...] = ()) -> list[dict]:
    """Columns of a table; the optional ones may be null, the unit ones lie between 0 and 1."""
    return [{"name": n, "nullable": n in optional, "range": _UNIT if n in unit else None} for n in names]


# Columns of every report table, in order.
_EVENT_COLUMNS = [
    "optimization_run_id",
    "execution_mode",
    "scenario_key",
    "capacity_scenario",
    "capacity_per_hour",
    "minimum_candidate_probability",
    "calendar_date",
    "hour_of_day",
    "horizon_id",
    "stop_event_key",
    "journey_id",
    "station_id",
    "station_name",
    "train_type",
    "line_number",
    "train_service_key",
    "service_class",
    "predicted_severe_delay_probability",
    "actual_is_departure_severe_delay",
    "prediction_split",
    "is_eligible_candidate",
    "eligibility_reason",
    "selected_for_review",
    "candidate_priority_rank",
    "selection_rank",
    "priority_score",
    "objective_contribution",
    "solver_status",
    "model_name",
    "model_version",
    "selected_threshold",
    "optimized_at",
    BIN,
    "Review Eligibility",
    "Review Decision",
    "Actual Outcome",
    "Predicted Risk Band",
    "Predicted Risk Band Sort",
]
_HORIZON_COLUMNS = [
    "optimization_run_id",
    "execution_mode",
    "scenario_key",
    "calendar_date",
    "hour_of_day",
    "horizon_id",
    "capacity_scenario",
    "capacity_per_hour",
    "candidate_count",
    "eligible_candidate_count",
    "selected_event_count",
    "unused_capacity",
    "selected_probability_score_sum",
    "actual_severe_selected_count",
    "actual_severe_candidate_count",
    "candidate_prevalence",
    "precision_at_capacity",
    "severe_delay_coverage",
    "lift_over_candidate_prevalence",
    "solver_status",
    "model_name",
    "model_version",
    "optimized_at",
]
_SHARES = ("candidate_prevalence", "precision_at_capacity", "severe_delay_coverage")
_RATIOS = (*_SHARES, "lift_over_candidate_prevalence")

METRIC_COLUMNS = [
    *SUMMARY_COLUMNS[:2],
    "policy_name",
    "policy_display_name",
    "policy_sort_order",
    *SUMMARY_COLUMNS[3:],
    "selected_stop_event_key_hash",
    "candidate_pool_fingerprint",
]
COMPARISON_COLUMNS = [
    "optimization_run_id",
    "execution_mode",
    "policy_name",
    "policy_display_name",
    "policy_sort_order",
    "capacity_scenario",
    "capacity_per_hour",
    "horizon_count",
    "selected_event_count",
    "selected_severe_event_count",
    "precision_at_capacity",
    "severe_delay_coverage",
    "lift_vs_random",
    "expected_risk_score_captured",
    "distinct_stations_covered",
    "max_selected_same_station_in_horizon",
    "station_concentration_excess_total",
    "mean_station_concentration_excess_per_horizon",
    "unused_capacity_total",
    "mean_unused_capacity_per_horizon",
    "binding_horizon_count",
    "binding_horizon_rate",
    "candidate_shortage_horizon_count",
    "candidate_shortage_horizon_rate",
    "median_feasible_selection_target",
    "preferred_station_load_per_station_hour",
    "frozen_station_excess_penalty_lambda",
    "candidate_pool_fingerprint",
    "scoring_model_name",
    "scoring_model_version",
    "optimization_policy_version",
    "optimized_at",
]

_RUN_METADATA = [
    "optimization_run_id",
    "candidate_pool_fingerprint",
    "scoring_model_name",
    "scoring_model_version",
    "optimization_policy_version",
    "optimized_at",
]
_COMPARED = {
    "selected_severe_event_count": "long",
    "precision_at_capacity": "double",
    "severe_delay_coverage": "double",
    "mean_station_concentration_excess_per_horizon": "double",
    "mean_unused_capacity_per_horizon": "double",
}
_JUDGED_NAMES = ["policy_name", "policy_display_name", *_COMPARED]
PAIRWISE_COLUMNS = [
    "execution_mode",
    "capacity_per_hour",
    "compared_horizon_count",
    "win_horizon_count",
    "tie_horizon_count",
    "loss_horizon_count",
    "selected_set_match_rate",
    *[f"comparator_{c}" for c in _JUDGED_NAMES],
    *_RUN_METADATA,
    *[f"reference_{c}" for c in _JUDGED_NAMES],
    *[f"{c}_delta" for c in _COMPARED],
]
_PAIRWISE_RATIOS = ("precision_at_capacity", "severe_delay_coverage")

CONTRACTS = {
    "fact_event_decision": _contract(
        _EVENT_COLUMNS,
        (
            "journey_id",
            "predicted_severe_delay_probability",
            "actual_is_departure_severe_delay",
            "selection_rank",
            "priority_score",
            "objective_contribution",
            BIN,
        ),
    ),
    "fact_horizon_summary": _contract(_HORIZON_COLUMNS, _RATIOS, _SHARES),
    "dim_date_hour": _contract(["horizon_id", "calendar_date", "hour_of_day", "date_label", "hour_label"]),
    "dim_station": _contract(["station_id", "station_name"]),
    "dim_train_service": _contract(["train_service_key", "train_type", "line_number", "service_class"]),
    "dim_scenario": _contract([
        "scenario_key",
        "capacity_scenario",
        "capacity_per_hour",
        "minimum_candidate_probability",
        "model_name",
        "model_version",
        "selected_threshold",
        "policy_version",
        "frozen_at",
        "scenario_display_name",
    ]),
    "fact_policy_comparison": _contract(
        COMPARISON_COLUMNS, ("precision_at_capacity", "severe_delay_coverage", "lift_vs_random"), _SHARES
    ),
    "fact_horizon_policy_metrics": _contract(METRIC_COLUMNS, _RATIOS, _SHARES),
    "fact_policy_pairwise_summary": _contract(
        PAIRWISE_COLUMNS,
        tuple(f"{side}_{c}" for side in ("reference", "comparator") for c in _PAIRWISE_RATIOS) + tuple(f"{c}_delta" for c in _PAIRWISE_RATIOS),
        ("selected_set_match_rate", *[f"{side}_{c}" for side in ("reference", "comparator") for c in _PAIRWISE_RATIOS]),
    ),
}

# Many-to-one links of the report model: fact, dimension, key.
RELATIONSHIPS = (
    ("fact_event_decision", "dim_scenario", "scenario_key"),
    ("fact_horizon_summary", "dim_scenario", "scenario_key"),
    ("fact_event_decision", "dim_station", "station_id"),
    ("fact_event_decision", "dim_train_service", "train_service_key"),
    ("fact_event_decision", "dim_date_hour", "horizon_id"),
    ("fact_horizon_summary", "dim_date_hour", "horizon_id"),
)


def project(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table contract, in order."""
    names = [c["name"] for c in CONTRACTS[table]]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def station_names(feed: DataFrame) -> DataFrame:
    """One name per station id of the source feed; blank names do not count.

    Equal rows are merged before anything is compared (Spark would drop that step again if nothing were counted). Ids and names are
    tested on what is left, not in a filter, which would read them out of every source row a second time.
    """
    stations = feed.select(F.col("eva").cast("string").alias("station_id"), "station_name").distinct()
    named = F.col("station_id").isNotNull() & (F.trim("station_name") != "")
    names = stations.groupBy("station_id").agg(
        F.min(F.when(named, F.col("station_name"))).alias("_name"), F.count_if(named).alias("_named")
    )
    return names.filter("_named > 0").drop("_named")


def normalized_events(decisions: DataFrame, policy: Policy, names: DataFrame | None = None) -> DataFrame:
    """Event decisions with text keys, filled labels and the scenario key."""
    if "service_class" not in decisions.columns:
        merged = F.coalesce("service_class_y", "service_class_x")
        decisions = decisions.withColumn("service_class", merged)
    texts = {c: F.col(c).cast("string") for c in ("station_id", "stop_event_key", "journey_id", "calendar_date")}
    rows = decisions.withColumns({**texts, "scenario_key": F.lit(policy.search.optimization_policy_version)})
    if names is not None:
        rows = rows.join(names, "station_id", "left").withColumn("station_name", F.coalesce("station_name", "_name"))
        rows = rows.drop("_name")

    def filled(column: str, label: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(label))

    return rows.withColumns({
        "station_name": filled("station_name", labels.UNKNOWN_STATION),
        "train_type": filled("train_type", labels.UNKNOWN),
        "line_number": filled("line_number", labels.NO_LINE),
        "service_class": filled("service_class", labels.UNKNOWN),
        "eligibility_reason": filled("eligibility_reason", labels.UNKNOWN),
        "train_service_key": F.coalesce(F.col("train_service_key").cast("string"), F.col("journey_id")),
        "optimized_at": F.col("optimized_at").cast("string"),
    })


def fact_event_decision(events: DataFrame) -> DataFrame:
    p, eligible = F.col(PROBABILITY), F.coalesce("is_eligible_candidate", F.lit(False))
    rows = events.withColumns({
        BIN: labels.probability_bin(p),
        "Review Eligibility": labels.review_eligibility(eligible),
        "Review Decision": labels.review_decision(eligible, F.col("selected_for_review")),
        "Actual Outcome": labels.actual_outcome(F.col(OUTCOME)),
        "Predicted Risk Band": labels.risk_band(p),
        "Predicted Risk Band Sort": labels.risk_band_sort(p),
        "solver_status": labels.status_code(F.col("solver_status")),
    })
    return project(rows, "fact_event_decision")


def fact_horizon_summary(summary: DataFrame, policy: Policy) -> DataFrame:
    renamed = {
        c: F.col(c if c in summary.columns else f"scoring_{c}").cast("string") for c in ("model_name", "model_version")
    }
    rows = summary.withColumns({
        **renamed,
        "scenario_key": F.lit(policy.search.optimization_policy_version),
        "solver_status": labels.status_code(F.col("solver_status")),
    })
    return project(rows, "fact_horizon_summary")


def dim_date_hour(horizon_fact: DataFrame) -> DataFrame:
    rows = horizon_fact.select("horizon_id", "calendar_date", "hour_of_day").distinct()
    return project(
        rows.withColumns({"date_label": F.col("calendar_date"), "hour_label": hour_label(F.col("hour_of_day"))}),
        "dim_date_hour",
    )


def dim_station(event_fact: DataFrame) -> DataFrame:
    return project(event_fact.select("station_id", "station_name").distinct(), "dim_station")


def dim_train_service(event_fact: DataFrame) -> DataFrame:
    columns = ["train_service_key", "train_type", "line_number", "service_class"]
    return project(event_fact.select(*columns).distinct(), "dim_train_service")


def dim_scenario(spark: SparkSession, policy: Policy) -> DataFrame:
    version = F.lit(policy.search.optimization_policy_version)
    values = {
        "scenario_key": version,
        "capacity_scenario": F.lit(policy.capacity_scenario),
        "capacity_per_hour": F.lit(policy.capacity_per_hour),
        "minimum_candidate_probability": F.lit(float(policy.threshold)),
        "model_name": F.lit(policy.scoring_model_name),
        "model_version": F.lit(policy.scoring_model_version),
        "selected_threshold": F.lit(float(policy.selected_threshold)),
        "policy_version": version,
        "frozen_at": F.lit(policy.frozen_at),
        "scenario_display_name": labels.scenario_display_name(policy),
    }
    return project(spark.range(1).select(*[v.alias(k) for k, v in values.items()]), "dim_scenario")


# ---- policy facts --------------------------------------------------------------------------------

_POOL = [
    "horizon_id",
    "candidate_count",
    "eligible_candidate_count",
    "feasible_selection_target",
    "actual_severe_candidate_count",
]
_RUN = ["execution_mode", "capacity_per_hour"]


def pool_fingerprints(metrics: DataFrame) -> DataFrame:
    """Digest of the candidate pool per capacity.

    The digested list has one short entry per calendar hour, taken once for all policies.
    """
    pool = metrics.select(*_RUN, F.struct(*_POOL).alias("entry")).distinct()
    entries = F.array_sort(F.collect_list("entry"))
    text = F.to_json(entries, {"ignoreNullFields": "false"})
    return pool.groupBy(*_RUN).agg(F.sha2(text, 256).alias("candidate_pool_fingerprint"))


def _with_display(rows: DataFrame, exact: str) -> DataFrame:
    name = F.col("policy_name")
    return rows.withColumns({
        "policy_display_name": labels.policy_display_name(name, exact),
        "policy_sort_order": labels.policy_sort_order(name, exact),
    })


def fact_horizon_policy_metrics(metrics: DataFrame, exact: str = EXACT) -> DataFrame:
    shown = _with_display(metrics, exact)
    return project(shown.join(F.broadcast(pool_fingerprints(metrics)), _RUN), "fact_horizon_policy_metrics")


def fact_policy_comparison(comparison: DataFrame, metrics_fact: DataFrame, exact: str = EXACT) -> DataFrame:
    """Comparison rows with run metadata, horizon count and per-horizon means.

    Metadata that differ between the horizons of a capacity are never shown: they are null, which the contract does not allow, and
    ``run_violations`` names them.
    """
    same = [F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c) for c in _RUN_METADATA]
    runs = metrics_fact.groupBy(*_RUN).agg(*same)
    horizons = F.col("binding_horizon_count") + F.col("candidate_shortage_horizon_count")
    rows = _with_display(comparison, exact).join(runs, _RUN, "left").withColumns({
        "horizon_count": horizons,
        "mean_station_concentration_excess_per_horizon": share(F.col("station_concentration_excess_total"), horizons),
        "mean_unused_capacity_per_horizon": share(F.col("unused_capacity_total"), horizons),
    })
    return project(rows, "fact_policy_comparison")


def _quality(prefix: str) -> Column:
    """Order of two choices of one horizon: severe hits, then score, then less excess, then less unused."""

    def value(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    return F.struct(
        value("actual_severe_selected_count").alias("hits"),
        F.round(value("selected_probability_score_sum"), 12).alias("score"),
        (-F.round(value("station_concentration_excess_total"), 12)).alias("spread"),
        (-value("unused_capacity")).alias("used"),
    )


def fact_policy_pairwise_summary(comparison: DataFrame, metrics: DataFrame, reference: str = EXACT) -> DataFrame:
    """Horizon-by-horizon wins of the reference policy over each other one, and the differences in totals."""
    at = ["execution_mode", "capacity_per_hour"]
    judged = [
        "actual_severe_selected_count",
        "selected_probability_score_sum",
        "station_concentration_excess_total",
        "unused_capacity",
        "selected_stop_event_key_hash",
    ]
    is_reference = F.col("policy_name") == reference
    ours = metrics.filter(is_reference).select(*at, "horizon_id", *[F.col(c).alias(f"a_{c}") for c in judged])
    theirs = metrics.filter(~is_reference).select(
        *at, "horizon_id", "policy_name", *[F.col(c).alias(f"b_{c}") for c in judged]
    )
    pairs = theirs.join(ours, [*at, "horizon_id"])
    better, worse = _quality("a_") > _quality("b_"), _quality("a_") < _quality("b_")
    equal = F.col("a_selected_stop_event_key_hash") == F.col("b_selected_stop_event_key_hash")
    scores = pairs.groupBy(*at, "policy_name").agg(
        F.count(F.lit(1)).alias("compared_horizon_count"),
        F.count_if(better).alias("win_horizon_count"),
        F.count_if(~better & ~worse).alias("tie_horizon_count"),
        F.count_if(worse).alias("loss_horizon_count"),
        F.avg(equal.cast("double")).alias("selected_set_match_rate"),
    )
    left = comparison.filter(is_reference).select(*at, *_RUN_METADATA, *[F.col(c).alias(f"reference_{c}") for c in _JUDGED_NAMES])
    right = comparison.filter(~is_reference).select(*at, "policy_name", *[F.col(c).alias(f"comparator_{c}") for c in _JUDGED_NAMES])
    rows = scores.join(right, [*at, "policy_name"], "left").join(left, at, "left")
    deltas = {f"{c}_delta": F.col(f"reference_{c}") - F.col(f"comparator_{c}") for c in _COMPARED}
    return project(rows.withColumns(deltas), "fact_policy_pairwise_summary")


# ---- checks --------------------------------------------------------------------------------------


def source_violations(events: DataFrame, summary: DataFrame, policy: Policy, horizon_count: int | None = None):
    """Invariants of the tables an export starts from, as (rule, violations)."""
    rules = quality.row_rules(
        events,
        {
            "events are final": F.col("execution_mode") != FINAL,
            "events are test rows": F.col("prediction_split") != TEST_SPLIT,
            "events have stations": F.col("station_id").isNull(),
            "events have services": F.col("train_service_key").isNull(),
            "events have horizons": F.col("horizon_id").isNull(),
            "events use the policy capacity": F.col("capacity_per_hour") != policy.capacity_per_hour,
            "events use the policy scenario": F.col("capacity_scenario") != policy.capacity_scenario,
            "events use the policy threshold": F.col("selected_threshold") != policy.selected_threshold,
            "events use the minimum probability": F.col("minimum_candidate_probability") != policy.threshold,
            "events use the policy model": (F.col("model_name") != policy.scoring_model_name)
            | (F.col("model_version") != policy.scoring_model_version),
        },
    )
    horizon_rules = quality.row_rules(
        summary,
        {
            "horizons are final": F.col("execution_mode") != FINAL,
            "horizons use the policy capacity": F.col("capacity_per_hour") != policy.capacity_per_hour,
            "horizons use the policy scenario": F.col("capacity_scenario") != policy.capacity_scenario,
        },
    )
    runs = events.select("optimization_run_id").unionByName(summary.select("optimization_run_id"))
    reports = [
        rules,
        horizon_rules,
        quality.duplicate_keys(events, ["stop_event_key"], "one row per event"),
        quality.duplicate_keys(summary, ["horizon_id"], "one row per horizon"),
        quality.broken_dependency(
            events, "horizon_id", ["calendar_date", "hour_of_day"], "horizon fixes date and hour"
        ),
        quality.single_value(events, ["optimization_run_id", "model_name", "model_version"], "one run and model"),
        quality.single_value(runs, ["optimization_run_id"], "one run in all tables"),
    ]
    if horizon_count is not None:
        counted = summary.agg((F.count(F.lit(1)) != horizon_count).cast("long").alias("violations"))
        reports.append(counted.select(F.lit("expected number of horizons").alias("rule"), "violations"))
    return quality.union_reports(*reports)


# Fields that both tables and the frozen policy must agree on, by their names in events and horizons.
_SHARED = {
    "optimization_run_id": "optimization_run_id",
    "model_name": "scoring_model_name",
    "model_version": "scoring_model_version",
    "capacity_scenario": "capacity_scenario",
    "capacity_per_hour": "capacity_per_hour",
}
_EVENTS_ONLY = ("minimum_candidate_probability", "selected_threshold")


def artifact_violations(
    events: DataFrame, horizons: DataFrame, policy: Policy, metadata: dict | None = None, horizon_count: int | None = None
) -> DataFrame:
    """Whether events, horizons, frozen policy and the metadata of the evaluation describe one run, as (rule, violations).

    Each field must have exactly one known value in a table (violations: the values beyond one, 1 if none is known), and that must be the value of
    the others (violations: rows that have another). ``metadata`` may name any of the fields. Every table is read once.
    """
    frozen = {
        "model_name": policy.scoring_model_name,
        "model_version": policy.scoring_model_version,
        "capacity_scenario": policy.capacity_scenario,
        "capacity_per_hour": policy.capacity_per_hour,
        "minimum_candidate_probability": float(policy.threshold),
        "selected_threshold": float(policy.selected_threshold),
    }
    metadata = {k: v for k, v in (metadata or {}).items() if k in frozen or k == "optimization_run_id"}
    sides = {"events": (events, {f: f for f in (*_SHARED, *_EVENTS_ONLY)}), "horizons": (horizons, _SHARED)}
    reports = []
    for side, (table, fields) in sides.items():
        rules = {}
        for field, column in fields.items():
            known = F.count_distinct(F.col(column))
            rules[f"{side}: one known {field}"] = F.abs(known - 1)
            for source, values in (("policy", frozen), ("metadata", metadata)):
                if field in values:
                    rules[f"{side}: {field} is that of the {source}"] = F.count_if(F.col(column) != F.lit(values[field]))
        counted = table.agg(*[v.cast("long").alias(rule) for rule, v in rules.items()])
        reports.append(counted.unpivot([], [F.col(f"`{rule}`") for rule in rules], "rule", "violations"))
    runs = events.agg(F.collect_set("optimization_run_id").alias("ours")).crossJoin(  # of one row each; a run has one id
        horizons.agg(F.collect_set("optimization_run_id").alias("theirs"))
    )
    apart = F.size(F.array_union(F.array_except("ours", "theirs"), F.array_except("theirs", "ours")))
    reports.append(runs.select(F.lit("events and horizons: same optimization_run_id").alias("rule"), apart.cast("long").alias("violations")))
    if horizon_count is not None:
        counted = horizons.agg(F.abs(F.count(F.lit(1)) - horizon_count).alias("violations"))
        reports.append(counted.select(F.lit("horizons: as many as the metadata say").alias("rule"), "violations"))
    return quality.union_reports(*reports)


def run_violations(metrics: DataFrame, comparison: DataFrame) -> DataFrame:
    """Capacities whose horizons carry conflicting or unknown run metadata, and comparison rows without any run, as (rule, violations)."""
    mixed = [
        ((F.min(c) != F.max(c)) | (F.count(c) != F.count(F.lit(1)))).alias(c) for c in _RUN_METADATA
    ]
    runs = metrics.groupBy(*_RUN).agg(*mixed)
    lone = comparison.select(*_RUN).join(metrics.select(*_RUN).distinct(), _RUN, "left_anti")
    return quality.union_reports(
        quality.row_rules(runs, {f"one {c} per capacity": F.coalesce(F.col(c), F.lit(True)) for c in _RUN_METADATA}),
        lone.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("comparison rows have a run").alias("rule"), "violations"),
    )


def dimension_conflicts(events: DataFrame) -> DataFrame:
    """Stations or services with more than one set of attributes; the tables must be normalised already."""
    service = ["train_type", "line_number", "service_class"]
    return quality.union_reports(
        quality.broken_dependency(events, "station_id", ["station_name"], "station fixes its name"),
        quality.broken_dependency(events, "train_service_key", service, "service fixes its attributes"),
    )


_RECONCILED = [
    "candidate_count",
    "eligible_candidate_count",
    "selected_event_count",
    "actual_severe_selected_count",
    "actual_severe_candidate_count",
    "selected_probability_score_sum",
]


def reconciliation(events: DataFrame, horizon_fact: DataFrame) -> DataFrame:
    """Horizons whose stored metrics differ from the events, as (rule, violations); also one-sided horizons."""
    selected, eligible, severe = F.col("selected_for_review"), F.col("is_eligible_candidate"), F.col(OUTCOME)
    derived = events.groupBy("horizon_id").agg(
        F.count(F.lit(1)).alias("_candidate_count"),
        F.count_if(eligible).alias("_eligible_candidate_count"),
        F.count_if(selected).alias("_selected_event_count"),
        F.count_if(selected & severe).alias("_actual_severe_selected_count"),
        F.count_if(eligible & severe).alias("_actual_severe_candidate_count"),
        F.sum(F.when(selected, F.coalesce("objective_contribution", F.lit(0.0))).otherwise(0.0)).alias(
            "_selected_probability_score_sum"
        ),
    )
    both = horizon_fact.select("horizon_id", *_RECONCILED).join(derived, "horizon_id", "full_outer")

    def differs(name: str) -> Column:
        left, right = F.col(name), F.col(f"_{name}")
        if name == "selected_probability_score_sum":
            left, right = F.round(left, 12), F.round(right, 12)
        return ~left.eqNullSafe(right)

    return quality.row_rules(both, {f"{name} agrees with events": differs(name) for name in _RECONCILED})


def policy_violations(metrics: DataFrame, comparison: DataFrame, pairwise: DataFrame, policy: Policy) -> DataFrame:
    """Completeness, grain and candidate-pool invariants of the policy facts."""
    expected = F.array_sort(F.array(*[F.lit(n) for n in policy.search.policy_names]))

    def incomplete(df: DataFrame, name: str) -> DataFrame:
        found = df.groupBy("capacity_per_hour").agg(F.array_sort(F.collect_set("policy_name")).alias("found"))
        return quality.row_rules(found, {name: F.col("found") != expected})

    unequal_pool = reduce(lambda a, b: a | b, [F.min(c) != F.max(c) for c in _POOL[1:]])
    pools = metrics.groupBy("execution_mode", "capacity_per_hour", "horizon_id").agg(
        unequal_pool.alias("mixed"), F.count(F.lit(1)).alias("n")
    )
    grain = ["optimization_run_id", "capacity_per_hour", "policy_name"]
    total = F.col("win_horizon_count") + F.col("tie_horizon_count") + F.col("loss_horizon_count")
    return quality.union_reports(
        incomplete(metrics, "metrics hold every policy"),
        incomplete(comparison, "comparison holds every policy"),
        quality.row_rules(
            pools,
            {
                "policies share a candidate pool": F.col("mixed"),
                "every policy decides every horizon": F.col("n") != len(policy.search.policy_names),
            },
        ),
        quality.duplicate_keys(comparison, grain, "one comparison row per policy"),
        quality.duplicate_keys(metrics, [*grain, "horizon_id"], "one metrics row per policy and horizon"),
        quality.row_rules(pairwise, {"wins, ties and losses add up": total != F.col("compared_horizon_count")}),
    )


def star_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Contracts, unique dimension keys and relationships of the finished tables."""
    reports = [
        quality.contract_violations(tables[name], columns, name)
        for name, columns in CONTRACTS.items()
        if name in tables
    ]
    for fact, dimension, key in RELATIONSHIPS:
        reports.append(quality.orphans(tables[fact], tables[dimension], key, f"{fact}.{key} in {dimension}"))
    for dimension, key in sorted({(d, k) for _, d, k in RELATIONSHIPS}):
        reports.append(quality.duplicate_keys(tables[dimension], [key], f"{dimension}.{key} is unique"))
    return quality.union_reports(*reports)


def star_tables(spark: SparkSession, events: DataFrame, summary: DataFrame, policy: Policy) -> dict[str, DataFrame]:
    """Event and horizon facts with their dimensions; ``events`` must be normalised."""
    event_fact, horizon_fact = fact_event_decision(events), fact_horizon_summary(summary, policy)
    return {
        "fact_event_decision": event_fact,
        "fact_horizon_summary": horizon_fact,
        "dim_date_hour": dim_date_hour(horizon_fact),
        "dim_station": dim_station(event_fact),
        "dim_train_service": dim_train_service(event_fact),
        "dim_scenario": dim_scenario(spark, policy),
    }
