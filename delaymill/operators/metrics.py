"""Evaluation of scored rows: thresholds, confusion, ranking quality, scope report.

Inputs have a score column and a boolean target; ``by`` names the grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.functions.delays import share
from delaymill.operators.ranking import running_totals

# Thresholds that are tried.
THRESHOLDS = tuple(round(step * 0.05, 2) for step in range(1, 20))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; zero where undefined."""
    return {
        "precision": _or_zero(share(tp, tp + fp)),
        "recall": _or_zero(share(tp, tp + fn)),
        "f1": _or_zero(share(2 * tp, 2 * tp + fp + fn)),
    }


def threshold_scan(scored: DataFrame, score: str, target: str, by: list[str]) -> DataFrame:
    """Counts and rates at every threshold.

    Rows are reduced to one count per number of passed thresholds before the thresholds are laid out.
    """
    passed = sum((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") for t in THRESHOLDS), F.lit(0))
    steps = scored.groupBy(*by, passed.alias("step")).agg(
        F.count_if(F.col(target)).alias("hit"), F.count_if(~F.col(target)).alias("miss")
    )
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS, 1)])
    laid_out = steps.select("*", F.explode(table).alias("t")).withColumn("chosen", F.col("step") >= F.col("t.i"))
    counts = laid_out.groupBy(*by, F.col("t.threshold").alias("threshold")).agg(
        F.sum(F.when(F.col("chosen"), F.col("hit")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("chosen"), F.col("miss")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("chosen"), 0).otherwise(F.col("hit"))).alias("fn"),
    )
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(scan: DataFrame) -> DataFrame:
    """The threshold with the best F1; the lowest one on ties."""
    return scan.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def confusion(scored: DataFrame, score: str, target: str, threshold: float | Column, by: list[str]) -> DataFrame:
    chosen = F.coalesce(F.col(score) >= threshold, F.lit(False))
    actual = F.col(target)
    counts = scored.groupBy(*by).agg(
        F.count_if(~chosen & ~actual).alias("tn"),
        F.count_if(chosen & ~actual).alias("fp"),
        F.count_if(~chosen & actual).alias("fn"),
        F.count_if(chosen & actual).alias("tp"),
    )
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def ranking_metrics(scored: DataFrame, score: str, target: str, by: list[str]) -> DataFrame:
    """ROC-AUC and average precision, exact also for tied scores.

    Rows are first reduced to one per distinct score; running totals over scores of any number are
    linked between range-partitioned slices.
    """
    known = scored.filter(F.col(score).isNotNull())
    per_score = known.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(target)).alias("_hit"), F.count_if(~F.col(target)).alias("_miss")
    )
    sums = {"_hit": "_tp", "_miss": "_fp"}
    ranked = running_totals(per_score, by, [F.col("_score").desc()], sums)
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    # a negative of this score loses against all positives above it and ties with its own
    area = F.col("_miss") * (F.col("_tp") - F.col("_hit") / 2)
    totals = ranked.groupBy(*by).agg(
        F.sum("_hit").alias("positives"),
        F.sum("_miss").alias("negatives"),
        F.sum(F.col("_hit") * precision).alias("_ap"),
        F.sum(area).alias("_area"),
    )
    return totals.select(
        *by,
        "positives",
        "negatives",
        F.try_divide("_ap", "positives").alias("pr_auc"),
        F.try_divide("_area", F.col("positives") * F.col("negatives")).alias("roc_auc"),
    )


def prevalence(rows: DataFrame, target: str) -> DataFrame:
    return rows.agg(F.avg(F.col(target).cast("double")).alias("naive_baseline_prevalence"))


def scope_report(scored: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    """What a frozen threshold selects in each scope slice."""
    chosen = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return scored.groupBy("scope_slice").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("journey_id").alias("journey_count"),
        F.count_if(F.col(target)).alias("severe_event_count"),
        F.count_if(chosen).alias("selected_by_frozen_threshold_count"),
        F.count_if(chosen & F.col(target)).alias("selected_severe_event_count"),
        F.avg(score).alias("mean_probability"),
        F.max(score).alias("max_probability"),
        F.min("service_date").alias("service_date_min"),
        F.max("service_date").alias("service_date_max"),
    )
