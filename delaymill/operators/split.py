"""Modelling rows and their split in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymill.session import spool

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# Share of anchor dates up to the end of training and of validation.
TRAIN_SHARE = 0.6
VALIDATION_SHARE = 0.8

TARGET = "is_departure_severe_delay"

# Features the model may see.
CATEGORICAL = ("station_id", "train_type", "line_number", "service_class", "day_name", "time_band")
NUMERIC = ("hour_of_day", "day_of_week", "month", "week_of_year", "arrival_delay_min")
BOOLEAN = ("is_weekend", "is_cancellation", "is_arrival_cancelled", "has_arrival_time_data")
ALLOWED_FEATURES = CATEGORICAL + NUMERIC + BOOLEAN

# Columns that identify a modelling row.
IDENTIFIERS = (
    "stop_event_key",
    "journey_id",
    "service_date",
    "station_id",
    "train_type",
    "line_number",
    "source_file",
)

# Columns that would leak the outcome or the split into the features.
EXCLUDED_FEATURES = (
    "stop_event_key",
    "date_key",
    "hour_key",
    "station_key",
    "train_service_key",
    "service_date",
    "calendar_date",
    "journey_id",
    "stop_sequence",
    "station_name",
    "train_number",
    "year",
    "provider_delay_in_min",
    "departure_delay_min",
    "delay_change_min",
    "event_delay_min",
    "has_delay_measurement",
    "is_delayed",
    "is_severe_delay",
    "is_extreme_delay",
    "delay_bucket",
    "is_departure_cancelled",
    "has_departure_time_data",
    "is_active_stop",
    "is_departure_severe_delay",
    "journey_anchor_date",
    "prediction_split",
)


def require_columns(df: DataFrame, names, what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def _split_ends(anchors: DataFrame) -> DataFrame:
    """One row: last anchor date of training and of validation.

    The windows run over distinct calendar dates, whose number is bounded by the calendar.
    """
    dates = anchors.select("journey_anchor_date").filter("journey_anchor_date IS NOT NULL").distinct()
    by_date = Window.orderBy("journey_anchor_date")
    numbered = dates.select(
        "journey_anchor_date",
        F.row_number().over(by_date).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"),
    )
    train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(TRAIN_SHARE)))
    wanted = F.greatest(F.col("train") + 1, F.floor(F.col("n") * F.lit(VALIDATION_SHARE)))
    cut = numbered.withColumn("train", train).withColumn("until", F.least(wanted, F.col("n") - 1))
    cut = cut.withColumn("train", F.least(F.col("train"), F.col("until") - 1))
    ends = cut.agg(
        F.max(F.when(F.col("i") == F.col("train"), F.col("journey_anchor_date"))).alias("train_end"),
        F.max(F.when(F.col("i") == F.col("until"), F.col("journey_anchor_date"))).alias("validation_end"),
        F.max("n").alias("n"),
    )
    message = F.lit("a split needs at least three distinct journey anchor dates")
    enough = F.when(F.coalesce("n", F.lit(0)) < 3, F.raise_error(message).cast("date"))
    return ends.select(
        F.struct(enough.otherwise(F.col("train_end")).alias("train_end"), F.col("validation_end")).alias("ends")
    )


def anchor_split(rows: DataFrame) -> DataFrame:
    """Adds the first service date of each journey and the split that date falls into.

    The first dates are pre-aggregated per journey, so a journey of any size costs one small row per task,
    and stored, so that the join back may broadcast them or split hot journeys.
    """
    require_columns(rows, ("journey_id", "service_date"), "split input")
    anchors = spool(rows.groupBy("journey_id").agg(F.min("service_date").alias("journey_anchor_date")), "anchors")
    ends = _split_ends(anchors).scalar()
    anchor = F.col("journey_anchor_date")
    split = (
        F.when(anchor <= ends.getField("train_end"), TRAIN)
        .when(anchor <= ends.getField("validation_end"), VALIDATION)
        .when(anchor.isNotNull(), TEST)
    )
    return rows.join(anchors.withColumn("prediction_split", split), "journey_id", "left").select(
        *rows.columns, "journey_anchor_date", "prediction_split"
    )


def modeling_frame(features: DataFrame) -> DataFrame:
    """Allow-listed columns of rows with a known target that were not cancelled."""
    names = list(
        dict.fromkeys([*IDENTIFIERS, "journey_anchor_date", "prediction_split", *ALLOWED_FEATURES, TARGET])
    )
    require_columns(features, [*names, "is_departure_cancelled"], "feature layer")
    ran = F.col(TARGET).isNotNull() & ~F.col("is_cancellation") & ~F.col("is_departure_cancelled")
    return features.filter(ran).select(*names)


def typed_features(rows: DataFrame) -> DataFrame:
    """Booleans as 0/1, numbers as doubles; text that is no number becomes null."""
    numeric = {c: F.col(c).cast("string").try_cast("double") for c in NUMERIC}
    return rows.withColumns({**{c: F.col(c).cast("int") for c in BOOLEAN}, **numeric})


def split_metrics(rows: DataFrame) -> DataFrame:
    positives = F.count_if(F.col(TARGET))
    return rows.groupBy(F.col("prediction_split").alias("split")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("journey_id").alias("journey_count"),
        positives.alias("positive_count"),
        F.count_if(~F.col(TARGET)).alias("negative_count"),
        F.avg(F.col(TARGET).cast("double")).alias("prevalence"),
        F.min("journey_anchor_date").alias("anchor_date_min"),
        F.max("journey_anchor_date").alias("anchor_date_max"),
    )


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prediction_split").agg(F.count(F.lit(1)).alias("row_count"))


def split_violations(rows: DataFrame) -> DataFrame:
    """Broken split rules as (rule, violations): rows without split, crossing journeys, overlapping dates, one-class splits."""
    per_journey = rows.groupBy("journey_id").agg(
        F.min("prediction_split").alias("low"), F.max("prediction_split").alias("high")
    )
    crossing = per_journey.agg(F.count_if(F.col("low") != F.col("high")).alias("violations"))

    def date_of(function, split: str):
        return function(F.when(F.col("prediction_split") == split, F.col("journey_anchor_date")))

    def one_class(split: str):
        inside = F.col("prediction_split") == split
        return (F.count_if(inside & F.col(TARGET)) == 0) | (F.count_if(inside & ~F.col(TARGET)) == 0)

    whole = rows.agg(
        (date_of(F.max, TRAIN) >= date_of(F.min, VALIDATION)).alias("train_before_validation"),
        (date_of(F.max, VALIDATION) >= date_of(F.min, TEST)).alias("validation_before_test"),
        *[one_class(s).alias(f"both_classes_in_{s}") for s in (TRAIN, VALIDATION, TEST)],
    )
    flags = whole.select(*[F.coalesce(F.col(c), F.lit(True)).cast("long").alias(c) for c in whole.columns])
    unknown = rows.agg(F.count_if(F.col("prediction_split").isNull()).alias("violations"))
    reports = [crossing.select(F.lit("one_split_per_journey").alias("rule"), "violations")]
    reports.append(unknown.select(F.lit("split_is_known").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, reports, flags.unpivot([], flags.columns, "rule", "violations"))
