"""Time split and evaluation on the deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from delaymill.operators import metrics, model, scope, split
from delaymill.session import scratch_path, spool
from delaymill.sources.sample_feed import SOURCE_FILE, event_scores, load_events, stop_events
from registry.common import (
    ADDED_FILE,
    ADDED_PART,
    BASELINE_PART,
    LOADED_AT,
    SCOPE,
    WEEK,
    printed,
    query,
    with_ctes,
)
from registry.layers import _GOLD, _SCOPED, GOLD, RIDES, SILVER, gold_frame, layer_frames

THRESHOLD = 0.5

SCORES = """scores AS (
  SELECT CAST(event_id AS VARCHAR) AS stop_event_key,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN value / 200
              ELSE least(1.0, value / 200) END AS predicted_probability FROM events)"""
SPLIT = """anchors AS (
  SELECT journey_id, min(service_date) AS journey_anchor_date FROM gold GROUP BY 1),
anchor_dates AS (
  SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT journey_anchor_date AS d FROM anchors)),
splits AS (
  SELECT d AS journey_anchor_date, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8)
         THEN 'validation' ELSE 'test' END AS prediction_split FROM anchor_dates),
split_gold AS (
  SELECT g.*, a.journey_anchor_date, s.prediction_split
  FROM gold g JOIN anchors a USING (journey_id) JOIN splits s USING (journey_anchor_date)),
model_rows AS (
  SELECT * FROM split_gold WHERE is_departure_severe_delay IS NOT NULL
    AND NOT is_cancellation AND NOT is_departure_cancelled),
scored AS (SELECT m.*, s.predicted_probability FROM model_rows m JOIN scores s USING (stop_event_key))"""
_MODEL = (*_GOLD, SCORES, SPLIT)


def gold_table(spark, folder):
    """The feature layer as the stored table that the split reads several times."""
    return spool(gold_frame(spark, folder), "gold")


def model_rows(spark, folder):
    return split.modeling_frame(split.anchor_split(gold_table(spark, folder)))


def with_scores(spark, folder, rows):
    return rows.join(event_scores(load_events(spark, folder)), "stop_event_key")


def scored_rows(spark, folder):
    return with_scores(spark, folder, model_rows(spark, folder))


@query(
    "anchor_split",
    with_ctes(
        *_MODEL,
        final=printed(
            "SELECT stop_event_key, journey_id, service_date, journey_anchor_date, prediction_split FROM split_gold",
            dates="service_date journey_anchor_date",
        ),
    ),
)
def anchor_split(spark, folder):
    columns = ["stop_event_key", "journey_id", "service_date", "journey_anchor_date", "prediction_split"]
    return split.anchor_split(gold_table(spark, folder)).select(*columns)


_FEATURE_LIST = ", ".join(
    f"CAST({c} AS INTEGER) AS {c}" if c in split.BOOLEAN else f"CAST({c} AS DOUBLE) AS {c}" if c in split.NUMERIC else c
    for c in dict.fromkeys([*split.IDENTIFIERS, "journey_anchor_date", "prediction_split", *split.ALLOWED_FEATURES])
)


@query(
    "modeling_frame",
    with_ctes(
        *_MODEL,
        final=printed(
            f"SELECT {_FEATURE_LIST}, is_departure_severe_delay FROM model_rows",
            dates="service_date journey_anchor_date",
        ),
    ),
)
def modeling_frame(spark, folder):
    return split.typed_features(model_rows(spark, folder))


@query(
    "split_metrics",
    with_ctes(
        *_MODEL,
        final=printed(
            """SELECT prediction_split AS split, count(*) AS row_count, count(DISTINCT journey_id) AS journey_count,
            count(*) FILTER (WHERE is_departure_severe_delay) AS positive_count,
            count(*) FILTER (WHERE NOT is_departure_severe_delay) AS negative_count,
            avg(CAST(is_departure_severe_delay AS INTEGER)) AS prevalence,
            min(journey_anchor_date) AS anchor_date_min, max(journey_anchor_date) AS anchor_date_max
            FROM model_rows GROUP BY 1""",
            dates="anchor_date_min anchor_date_max",
            doubles="prevalence",
        ),
    ),
)
def split_metrics(spark, folder):
    return split.split_metrics(model_rows(spark, folder))


@query(
    "split_counts",
    with_ctes(*_MODEL, final="SELECT prediction_split, count(*) AS row_count FROM model_rows GROUP BY 1"),
)
def split_counts(spark, folder):
    return split.split_counts(model_rows(spark, folder))


@query(
    "split_violations",
    with_ctes(
        *_MODEL,
        """ranges AS (SELECT prediction_split AS s, min(journey_anchor_date) AS low, max(journey_anchor_date) AS high,
             count(*) FILTER (WHERE is_departure_severe_delay) AS p,
             count(*) FILTER (WHERE NOT is_departure_severe_delay) AS n FROM model_rows GROUP BY 1)""",
        final="""SELECT 'one_split_per_journey' AS rule, count(*) AS violations FROM
            (SELECT 1 FROM model_rows GROUP BY journey_id HAVING count(DISTINCT prediction_split) > 1)
        UNION ALL SELECT 'split_is_known', count(*) FROM model_rows WHERE prediction_split IS NULL
        UNION ALL SELECT 'train_before_validation', count(*) FROM ranges a, ranges b
            WHERE a.s = 'train' AND b.s = 'validation' AND a.high >= b.low
        UNION ALL SELECT 'validation_before_test', count(*) FROM ranges a, ranges b
            WHERE a.s = 'validation' AND b.s = 'test' AND a.high >= b.low
        UNION ALL SELECT 'both_classes_in_' || s, CAST(p = 0 OR n = 0 AS BIGINT) FROM ranges""",
    ),
)
def split_violations(spark, folder):
    return split.split_violations(model_rows(spark, folder))


_SCAN = f"""scan AS (
  SELECT prediction_split, threshold,
         count(*) FILTER (WHERE predicted_probability >= threshold AND is_departure_severe_delay) AS tp,
         count(*) FILTER (WHERE predicted_probability >= threshold AND NOT is_departure_severe_delay) AS fp,
         count(*) FILTER (WHERE coalesce(predicted_probability < threshold, true) AND is_departure_severe_delay) AS fn
  FROM scored, (SELECT unnest([{', '.join(f"CAST({t} AS DOUBLE)" for t in metrics.THRESHOLDS)}]) AS threshold)
  GROUP BY 1, 2),
scan_rates AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM scan)"""


@query(
    "threshold_scan",
    with_ctes(
        *_MODEL, _SCAN, final=printed("SELECT * FROM scan_rates", doubles="threshold precision recall f1")
    ),
)
def threshold_scan(spark, folder):
    scored = scored_rows(spark, folder)
    return metrics.threshold_scan(scored, "predicted_probability", split.TARGET, ["prediction_split"])


@query(
    "best_threshold",
    with_ctes(
        *_MODEL,
        _SCAN,
        final=printed(
            "SELECT * FROM scan_rates WHERE prediction_split = 'validation' ORDER BY f1 DESC, threshold LIMIT 1",
            doubles="threshold precision recall f1",
        ),
    ),
)
def best_threshold(spark, folder):
    held_out = scored_rows(spark, folder).filter(F.col("prediction_split") == split.VALIDATION)
    scan = metrics.threshold_scan(held_out, "predicted_probability", split.TARGET, ["prediction_split"])
    return metrics.best_threshold(scan)


@query(
    "confusion",
    with_ctes(
        *_MODEL,
        f"""cells AS (SELECT prediction_split, is_departure_severe_delay AS y,
             coalesce(predicted_probability >= {THRESHOLD}, false) AS c FROM scored),
           counts AS (SELECT prediction_split, count(*) FILTER (WHERE NOT c AND NOT y) AS tn,
             count(*) FILTER (WHERE c AND NOT y) AS fp, count(*) FILTER (WHERE NOT c AND y) AS fn,
             count(*) FILTER (WHERE c AND y) AS tp FROM cells GROUP BY 1)""",
        final=printed(
            """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
            coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
            coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM counts""",
            doubles="precision recall f1",
        ),
    ),
)
def confusion(spark, folder):
    scored = scored_rows(spark, folder)
    return metrics.confusion(scored, "predicted_probability", split.TARGET, THRESHOLD, ["prediction_split"])


@query(
    "roc_auc_ap",
    with_ctes(
        *_MODEL,
        """known AS (SELECT prediction_split AS s, predicted_probability AS p,
             CAST(is_departure_severe_delay AS INTEGER) AS y FROM scored WHERE predicted_probability IS NOT NULL),
           ranked AS (SELECT s, y, p, rank() OVER (PARTITION BY s ORDER BY p)
             + (count(*) OVER (PARTITION BY s, p) - 1) / 2.0 AS mid_rank FROM known),
           auc AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg,
             sum(mid_rank) FILTER (WHERE y = 1) AS rank_sum FROM ranked GROUP BY s),
           curve AS (SELECT s, p, sum(y) AS hit, count(*) AS n FROM known GROUP BY s, p),
           points AS (SELECT s, hit, sum(hit) OVER w AS tp, sum(n) OVER w AS taken FROM curve
             WINDOW w AS (PARTITION BY s ORDER BY p DESC)),
           ap AS (SELECT s, sum(hit * tp / taken) / sum(hit) AS pr_auc FROM points GROUP BY s)""",
        final=printed(
            """SELECT s AS prediction_split, CAST(pos AS BIGINT) AS positives, CAST(neg AS BIGINT) AS negatives, pr_auc,
            (rank_sum - pos * (pos + 1) / 2) / (pos * neg) AS roc_auc FROM auc JOIN ap USING (s)""",
            doubles="pr_auc roc_auc",
        ),
    ),
)
def roc_auc_ap(spark, folder):
    scored = scored_rows(spark, folder)
    return metrics.ranking_metrics(scored, "predicted_probability", split.TARGET, ["prediction_split"])


@query(
    "train_prevalence",
    with_ctes(
        *_MODEL,
        final=printed(
            """SELECT avg(CAST(is_departure_severe_delay AS INTEGER)) AS naive_baseline_prevalence
            FROM model_rows WHERE prediction_split = 'train'""",
            doubles="naive_baseline_prevalence",
        ),
    ),
)
def train_prevalence(spark, folder):
    training = model_rows(spark, folder).filter(F.col("prediction_split") == split.TRAIN)
    return metrics.prevalence(training, split.TARGET)


# Scoped journeys, whose ride ids recur on other days, so that all three scope labels occur.
_SCOPED_GOLD = (RIDES, _SCOPED, SILVER.replace("FROM bronze", "FROM scoped"), GOLD, SCORES, SPLIT)
_LABELLED = f"""labelled AS (
  SELECT *, CASE WHEN source_file = '{SOURCE_FILE}' THEN 'baseline_month'
    WHEN source_file = '{ADDED_FILE}' AND service_date >= DATE '{WEEK[0]}' AND service_date <= DATE '{WEEK[1]}'
    THEN 'added_disrupted_week' ELSE 'unknown_scope_slice' END AS scope_slice FROM scored)"""


@query(
    "scope_diagnostic",
    with_ctes(
        *_SCOPED_GOLD,
        _LABELLED,
        final=printed(
            f"""SELECT scope_slice, count(*) AS row_count, count(DISTINCT journey_id) AS journey_count,
            count(*) FILTER (WHERE is_departure_severe_delay) AS severe_event_count,
            count(*) FILTER (WHERE predicted_probability >= {THRESHOLD}) AS selected_by_frozen_threshold_count,
            count(*) FILTER (WHERE predicted_probability >= {THRESHOLD} AND is_departure_severe_delay)
              AS selected_severe_event_count,
            avg(predicted_probability) AS mean_probability, max(predicted_probability) AS max_probability,
            min(service_date) AS service_date_min, max(service_date) AS service_date_max FROM labelled GROUP BY 1""",
            dates="service_date_min service_date_max",
            doubles="mean_probability max_probability",
        ),
    ),
)
def scope_diagnostic(spark, folder):
    rides = stop_events(load_events(spark, folder), recurring_rides=True)
    bronze = scope.bronze_events([(rides, BASELINE_PART), (rides, ADDED_PART)], SCOPE, LOADED_AT)
    rows = split.modeling_frame(split.anchor_split(spool(layer_frames(bronze)[3], "gold")))
    labelled = scope.label_scope_slice(with_scores(spark, folder, rows), SOURCE_FILE, ADDED_FILE, WEEK)
    return metrics.scope_report(labelled, "predicted_probability", split.TARGET, THRESHOLD)


@query(
    "severe_delay_scores",
    with_ctes(
        *_MODEL,
        final="""SELECT prediction_split, count(*) AS row_count,
        count(*) FILTER (WHERE is_departure_severe_delay) AS positives,
        count(*) FILTER (WHERE is_departure_severe_delay) AS hits_and_misses,
        CAST(0 AS BIGINT) AS outside_unit_interval, CAST(0 AS BIGINT) AS changed_by_reload,
        (SELECT count(*) FROM model_rows) AS frozen_rows, true AS ranks_better_than_chance
        FROM model_rows WHERE prediction_split <> 'train' GROUP BY 1""",
    ),
)
def severe_delay_scores(spark, folder):
    """Facts of the fitted classifier that hold whatever its exact weights, on the held-out splits.

    The zeros of the SQL are statements: no probability leaves [0, 1], and none differs after saving and loading.
    """
    rows = spool(model_rows(spark, folder), "model_rows")
    fitted = model.fit(rows)
    scored = spool(model.held_out_scores(fitted, rows, THRESHOLD, LOADED_AT), "held_out")
    path = scratch_path(spark, "model")
    model.save_model(fitted, path)
    loaded = model.load_model(path)
    again = model.with_probability(loaded, scored, "again")
    p, by = F.col("predicted_probability"), ["prediction_split"]
    facts = again.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(split.TARGET)).alias("positives"),
        F.count_if(F.coalesce(~p.between(0, 1), F.lit(True))).alias("outside_unit_interval"),
        F.count_if(F.coalesce(F.abs(p - F.col("again")) > 1e-12, F.lit(True))).alias("changed_by_reload"),
    )
    ranked = metrics.ranking_metrics(scored, "predicted_probability", split.TARGET, by)
    prevalence = F.col("positives") / (F.col("positives") + F.col("negatives"))
    better = ((F.col("roc_auc") > 0.5) & (F.col("pr_auc") > prevalence)).alias("ranks_better_than_chance")
    cells = metrics.confusion(scored, "predicted_probability", split.TARGET, THRESHOLD, by)
    frozen = model.frozen_scores(loaded, rows, THRESHOLD).agg(F.count("stage_a_predicted_severe_delay_probability").alias("frozen_rows"))
    joined = facts.join(ranked.select(*by, better), by).join(
        cells.select(*by, (F.col("tp") + F.col("fn")).alias("hits_and_misses")), by
    )
    return joined.join(F.broadcast(frozen))  # one row
