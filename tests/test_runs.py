"""The whole chain on the sample feed: files, layers, scores, selections, report tables."""

from datetime import date

from pyspark.sql import functions as F

from delaymill.config import ScopeConfig, ScopeSlice
from delaymill.operators import export, model
from delaymill.plans import runs
from delaymill.sources.layers import read_facts, read_part, read_stop_events
from delaymill.sources.sample_feed import load_events, stop_events

CLOCK = "2026-01-01T00:00:00+00:00"


def test_whole_run(spark, tmp_path):
    root = str(tmp_path / "out")
    feed = stop_events(load_events(spark, "/root/testdata/sf0.01"), recurring_rides=True)
    for name, days in (("data-2024-01.parquet", F.col("time") < "2024-01-18"), ("data-2024-02.parquet", None)):
        # the second file holds the later days, moved into February
        later = F.col("time") + F.expr("INTERVAL 14 DAYS")
        part = feed.filter(days) if days is not None else feed.filter("time >= '2024-01-18'").withColumn("time", later)
        part.write.parquet(f"{tmp_path}/source/{name}")
    january = read_stop_events(spark, f"{tmp_path}/source/data-2024-01.parquet")
    february = read_stop_events(spark, f"{tmp_path}/source/data-2024-02.parquet").withColumn(
        "source_file", F.lit("data-2024-02.parquet")
    )

    config = ScopeConfig("v1", "q1", "2024-01", "Station 7", "data-2024-01.parquet", "january@main")
    added = runs.pick_added_week(february, config.selected_hub)
    assert added.week_start.weekday() == 0 and added.source_file == "data-2024-02.parquet"
    baseline = ScopeSlice("baseline_month", config.source_file_name, config.source_version)
    layers = runs.build_layers(
        [(january, baseline), (february, added)], config, root, "2024-03-01 00:00:00"
    )
    assert layers["gold"].count() == layers["bronze"].count() > 2000

    labels = (config.source_file_name, added.source_file, (added.week_start, added.week_end))
    scored, threshold = runs.train_and_score(layers["gold"], root, CLOCK, labels)
    baseline = read_part(spark, f"{root}/ml/evaluation", "baseline").first()
    for row in read_part(spark, f"{root}/ml/evaluation", "held_out_metrics").collect():
        assert row["roc_auc"] > 0.8 and row["pr_auc"] > baseline["naive_baseline_prevalence"]
    assert read_facts(spark, f"{root}/ml/evaluation")["selected_threshold"] == threshold
    assert 0.05 <= threshold <= 0.95
    again = model.held_out_scores(model.load_model(f"{root}/ml/model"), scored.limit(50), threshold, CLOCK, "again")
    worst = again.agg(F.max(F.abs(F.col("again") - F.col("predicted_probability"))).alias("w")).first().w
    assert worst < 1e-12

    # stations and services of the layers serve as the missing attributes
    gold = layers["gold"].select("stop_event_key", "source_file", "train_service_key")
    enriched = scored.join(gold, ["stop_event_key", "source_file"]).withColumn(
        "train_service_key", F.concat_ws("-", "train_service_key")
    )
    tables, policy = runs.select_reviews(enriched, threshold, root, "r1", CLOCK)
    assert policy.station_penalty in policy.search.eligible_frozen_station_excess_penalty_lambdas
    comparison = tables["final/policy_comparison"]
    assert comparison.count() == 16
    names = layers["dim_station"].select("station_id", F.col("station_name").alias("_name"))
    written = runs.export_report(spark, tables, policy, root, names)
    assert set(written) == set(export.CONTRACTS) and len(written) == 9
    assert written["fact_policy_pairwise_summary"].count() == 12
    assert written["fact_event_decision"].filter(F.col("station_name") == "Unknown station").count() == 0
    assert read_facts(spark, f"{root}/optimization/frozen_policy")["capacity_scenario"] == "hourly_capacity_3"
    assert date.fromisoformat(read_part(spark, f"{root}/layer_summary", "slices").first()["min_service_date"])
