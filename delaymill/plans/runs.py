"""Whole runs: raw files to layers, layers to scores, scores to selections, selections to report tables.

Each stage writes its tables before the next one reads them, checks them, and leaves a JSON report beside them. Only run
parameters and rows of finished aggregates reach the driver.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.config import SPLIT_OF_MODE, Policy, ScopeConfig, ScopeSlice, SearchConfig
from delaymill.operators import candidates as cand
from delaymill.operators import export, features, metrics, model, outcomes, policies, quality, scope, split
from delaymill.operators import star_schema as star
from delaymill.operators.layer_checks import layer_violations
from delaymill.sources.layers import save_frame, save_layer_table, write_report


# how readers look rows up: files hold consecutive ranges of these keys
ORDERS = {"event_decision": ("horizon_id", "candidate_priority_rank", "stop_event_key")}


def pick_added_week(events: DataFrame, hub: str) -> ScopeSlice:
    """The most disrupted week of the candidate month files, as a scope slice."""
    found = scope.pick_week(scope.disrupted_weeks(events, hub)).first()
    if found is None:
        raise ValueError("no complete candidate week at the hub")
    version = f"monthly_processed_data/{found.source_file}@main"
    return ScopeSlice("added_disrupted_week", found.source_file, version, found.week_start_date)


def scope_manifest(spark: SparkSession, config: ScopeConfig, parts: list[ScopeSlice], weeks: DataFrame, path: str) -> None:
    """What was scoped and why, as a report: the slices as facts, the candidate weeks as a part."""
    facts = {
        "scope_version": config.scope_version,
        "extraction_query_version": config.extraction_query_version,
        "selected_hub": config.selected_hub,
        "baseline_source_file_name": config.source_file_name,
        "source_slices": [
            {
                "scope_slice": p.scope_slice,
                "source_file_name": p.source_file,
                "source_version": p.source_version,
                "scope_label": p.label(config.selected_month),
                "week_start_date": p.week_start,
                "week_end_date": p.week_end,
            }
            for p in parts
        ],
    }
    write_report(spark, facts, {"candidate_weeks": weeks}, path)


def build_layers(
    parts: list[tuple[DataFrame, ScopeSlice]], config: ScopeConfig, root: str, loaded_at: str
) -> dict[str, DataFrame]:
    """Bronze, silver and gold tables below ``root``, each checked against the layer before."""

    def save(df: DataFrame, layer: str, table: str, by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        return save_layer_table(df, root, layer, table, by, order)

    bronze = save(scope.bronze_events(parts, config, loaded_at), "bronze", "raw_stop_events", "scope_slice")
    manifest = save(scope.ingestion_manifest(bronze), "bronze", "raw_ingestion_manifest", order=("scope_slice", "source_file"))
    save(scope.station_reference(bronze), "bronze", "raw_station_reference")

    stations = save(star.dim_station(bronze), "silver", "dim_station")
    services = save(star.dim_train_service(bronze), "silver", "dim_train_service")
    save(star.dim_date(bronze), "silver", "dim_date")
    save(star.dim_hour(bronze), "silver", "dim_hour")
    fact = save(star.fact_stop_event(bronze, stations, services), "silver", "fact_stop_event", "service_date")

    gold = save(
        features.feature_stop_event(fact, stations, services), "gold", "feature_stop_event", "service_date"
    )
    hours = save(features.station_hour(gold), "gold", "fact_station_hour")

    quality.assert_clean(layer_violations(bronze, manifest, fact, stations, gold, hours, config.selected_hub))
    hub_rows = bronze.filter(F.col("station_name") == config.selected_hub)
    write_report(
        bronze.sparkSession,
        {"scope_version": config.scope_version},
        {
            "slices": scope.bronze_summary(bronze, config.selected_hub),
            "counts": features.layer_counts(bronze, fact, gold, stations),
            "hub_sample": hub_rows.select("id", "station_name", "train_type", "train_number", "train_line_ride_id").orderBy("id").limit(3),
        },
        f"{root}/layer_summary",
    )
    return {"bronze": bronze, "fact": fact, "gold": gold, "station_hour": hours, "dim_station": stations}


def train_and_score(
    gold: DataFrame, root: str, scored_at: str, labels: tuple[str, str, tuple[date, date]]
) -> tuple[DataFrame, float]:
    """Split, fit, choose the threshold on validation rows, score and report.

    ``labels`` names the baseline file, the added file and the added week.
    """
    rows = save_frame(split.modeling_frame(split.anchor_split(gold)), f"{root}/ml/model_rows")
    quality.assert_clean(split.split_violations(rows))
    fitted = model.fit(rows)
    model.save_model(fitted, f"{root}/ml/model")

    p, y, by = "predicted_probability", split.TARGET, ["prediction_split"]
    raw = save_frame(
        model.with_probability(fitted, rows.filter(F.col("prediction_split") != split.TRAIN), p), f"{root}/ml/held_out"
    )
    scan = metrics.threshold_scan(raw.filter(F.col("prediction_split") == split.VALIDATION), p, y, by)
    threshold = float(metrics.best_threshold(scan).first().threshold)

    def labelled(df: DataFrame) -> DataFrame:
        return scope.label_scope_slice(df, *labels)

    scored = save_frame(
        labelled(model.held_out_scores(fitted, rows, threshold, scored_at)), f"{root}/ml/scored_stop_events"
    )
    frozen = save_frame(labelled(model.frozen_scores(fitted, rows, threshold)), f"{root}/ml/stage_a_scored")
    training = rows.filter(F.col("prediction_split") == split.TRAIN)
    facts = {
        "model_name": model.MODEL_NAME,
        "model_version": model.MODEL_VERSION,
        "target_column": y,
        "feature_columns": split.ALLOWED_FEATURES,
        "excluded_feature_columns": split.EXCLUDED_FEATURES,
        "selected_threshold": threshold,
        "scored_at": scored_at,
    }
    report = {
        "split_metrics": split.split_metrics(rows),
        "held_out_metrics": metrics.ranking_metrics(scored, p, y, by).join(metrics.confusion(scored, p, y, threshold, by), by),
        "baseline": metrics.prevalence(training, y),
        "scored_split_counts": split.split_counts(scored),
        "scope_rows": metrics.scope_report(frozen, "stage_a_predicted_severe_delay_probability", y, threshold),
    }
    write_report(gold.sparkSession, facts, report, f"{root}/ml/evaluation")
    return scored, threshold


def tune_policy(candidates: DataFrame, horizons: DataFrame, seed: Policy, root: str) -> Policy:
    """Search load and penalty on the development mode and freeze the winner."""
    development = F.col("execution_mode") == "development"
    searched = policies.search_choices(candidates.filter(development), seed)
    tuning = save_frame(
        outcomes.tuning_results(horizons.filter(development), searched, seed),
        f"{root}/optimization/development/tuning_search_results",
    )
    winner = outcomes.tuning_winner(tuning).first()
    if winner is None:
        raise ValueError("no eligible development candidates to tune on")
    return replace(
        seed,
        preferred_station_load=int(winner.preferred_station_load_per_station_hour),
        station_penalty=float(winner.station_excess_penalty_lambda),
    ).check_frozen()


def select_reviews(
    scored: DataFrame, threshold: float, root: str, run_id: str, clock: str, search: SearchConfig | None = None
) -> tuple[dict[str, DataFrame], Policy]:
    """Tune, freeze, decide both modes under every policy and capacity, and write all results."""
    search = search or SearchConfig()
    seed = Policy(
        selected_threshold=threshold,
        scoring_model_name=model.MODEL_NAME,
        scoring_model_version=model.MODEL_VERSION,
        preferred_station_load=search.preferred_station_load_per_station_hour_candidates[0],
        station_penalty=search.eligible_frozen_station_excess_penalty_lambdas[0],
        capacity_per_hour=search.canonical_tuning_capacity_per_hour,
        search=search,
        run_id=run_id,
        optimized_at=clock,
        frozen_at=clock,
    )
    # candidates do not depend on the tuned values except for two recorded columns
    prepared = cand.rank_candidates(cand.prepare_candidates(scored, seed))
    seeds = save_frame(prepared, f"{root}/optimization/candidates")
    foreign = cand.candidate_violations(seeds, seed).agg(F.sum("foreign_model_rows").alias("violations"))
    quality.assert_clean(foreign.select(F.lit("one model version").alias("rule"), "violations"))
    horizons = save_frame(cand.horizon_candidates(seeds), f"{root}/optimization/horizons")
    policy = tune_policy(seeds, horizons, seed, root)
    capacity, exact = policy.capacity_per_hour, search.optimization_policy_name
    save_frame(cand.opportunity(horizons, capacity), f"{root}/optimization/development/opportunity_diagnostics")
    write_report(scored.sparkSession, policy.as_dict(), {}, f"{root}/optimization/frozen_policy")

    ranked = seeds.withColumns({
        "preferred_station_load_per_station_hour": F.lit(policy.preferred_station_load),
        "frozen_station_excess_penalty_lambda": F.lit(float(policy.station_penalty)),
    })
    results = save_frame(
        outcomes.horizon_outcomes(horizons, policies.choices(ranked, policy), policy), f"{root}/optimization/outcomes"
    )
    disallowed = outcomes.disallowed_statuses(results, policy).agg(F.count(F.lit(1)).alias("violations"))
    quality.assert_clean(disallowed.select(F.lit("allowed solver statuses").alias("rule"), "violations"))
    decisions = outcomes.event_decisions(ranked, results, policy, exact, capacity)
    canonical = (F.col("policy_name") == exact) & (F.col("capacity_per_hour") == capacity)
    tables = {}
    for mode in SPLIT_OF_MODE:
        chosen = F.col("execution_mode") == mode
        own = results.filter(chosen)
        frames = {
            "event_decision": decisions.filter(chosen),
            "horizon_summary": outcomes.horizon_summary(own.filter(canonical)),
            "horizon_policy_metrics": outcomes.horizon_policy_metrics(own),
            "policy_comparison": outcomes.policy_comparison(own),
        }
        for name, frame in frames.items():
            tables[f"{mode}/{name}"] = save_frame(frame, f"{root}/optimization/{mode}/{name}", order=ORDERS.get(name, ()))
        pairs = {f"pairwise_{other}": outcomes.pairwise_diagnostics(own, other, exact, capacity) for other in search.policy_names[1:3]}
        write_report(
            scored.sparkSession, {"mode": mode, "frozen_policy": policy.as_dict()}, pairs, f"{root}/optimization/{mode}/evaluation"
        )
    return tables, policy


def export_report(
    spark: SparkSession, tables: dict[str, DataFrame], policy: Policy, root: str, names: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Check the final-mode results, write the nine report tables and check those.

    ``names`` has ``station_id`` and ``_name`` for events without a station name.
    """
    exact = policy.search.optimization_policy_name
    events = save_frame(
        export.normalized_events(tables["final/event_decision"], policy, names), f"{root}/report/_events"
    )
    summary = tables["final/horizon_summary"]
    quality.assert_clean(
        quality.union_reports(
            export.source_violations(events, summary, policy),
            export.artifact_violations(events, summary, policy),
            export.dimension_conflicts(events),
        )
    )
    star_frames = export.star_tables(spark, events, summary, policy)
    metrics_fact = export.fact_horizon_policy_metrics(tables["final/horizon_policy_metrics"], exact)
    comparison = export.fact_policy_comparison(tables["final/policy_comparison"], metrics_fact, exact)
    frames = {
        **star_frames,
        "fact_horizon_policy_metrics": metrics_fact,
        "fact_policy_comparison": comparison,
        "fact_policy_pairwise_summary": export.fact_policy_pairwise_summary(comparison, metrics_fact, exact),
    }
    written = {name: save_frame(frame, f"{root}/report/{name}") for name, frame in frames.items()}
    quality.assert_clean(
        quality.union_reports(
            export.reconciliation(written["fact_event_decision"], written["fact_horizon_summary"]),
            export.run_violations(written["fact_horizon_policy_metrics"], written["fact_policy_comparison"]),
            export.policy_violations(
                written["fact_horizon_policy_metrics"],
                written["fact_policy_comparison"],
                written["fact_policy_pairwise_summary"],
                policy,
            ),
            export.star_violations(written),
        )
    )
    return written
