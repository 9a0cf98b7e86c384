"""Stop events and scores derived from the sample ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.config import STOP_EVENT_COLUMNS
from delaymill.functions.calendar import date_key
from delaymill.functions.delays import SEVERE_MINUTES, delay_minutes, service_class

TRAIN_TYPE_OF_EVENT = {"click": "ICE", "view": "RE", "purchase": "S", "signup": "IC", "error": "XX"}
SOURCE_FILE = "data-2024-01.parquet"


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def stop_events(events: DataFrame, recurring_rides: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """The feed schema on top of ``events``; with ``recurring_rides`` a ride id spans several days."""
    k = F.get_json_object("props", "$.k")
    delay = (F.floor(F.col("value") / 4) - 5).cast("int")
    minutes_of_day = F.hour("ts") * 60 + F.minute("ts")
    midnight = F.to_date("ts").cast("timestamp_ntz")
    one_minute = F.expr("INTERVAL '1' MINUTE")
    user = F.col("user_id").cast("string")
    day = date_key(F.to_date("ts")).cast("string")
    ride = user if recurring_rides else F.concat_ws("-", user, day)
    train_type = F.create_map(*[F.lit(x) for pair in TRAIN_TYPE_OF_EVENT.items() for x in pair])

    def clock(after: Column | int) -> Column:
        """The event's minute, moved by some minutes."""
        return midnight + one_minute * (minutes_of_day + after)

    arrives = F.col("event_id") % 11 != 0
    departs = F.col("event_id") % 13 != 0
    jitter = (F.col("event_id") % 3 - 1).cast("int")
    columns = {
        "station_name": F.concat(F.lit("Station "), k),
        "xml_station_name": F.concat(F.lit("STATION "), k),
        "eva": k,
        "train_number": (F.col("user_id") % 40).cast("string"),
        "line_number": F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 7).cast("string")),
        "final_destination_station": F.concat(F.lit("Station "), (F.col("user_id") % 100).cast("string")),
        "delay_in_min": delay,
        "time": F.col("ts"),
        "is_canceled": (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0),
        "train_type": train_type[F.col("event_type")],
        "train_line_ride_id": ride,
        "train_line_station_num": minutes_of_day.cast("int"),
        "arrival_planned_time": F.when(arrives, clock(0)),
        "arrival_change_time": F.when(arrives, clock(delay)),
        "departure_planned_time": F.when(departs, clock(2)),
        "departure_change_time": F.when(departs, clock(delay + 2 + jitter)),
        "id": F.col("event_id").cast("string"),
    }
    return events.select(*[columns[c].alias(c) for c in STOP_EVENT_COLUMNS], *also)


def event_score() -> Column:
    """A deterministic score per event, with some missing and some out-of-range values."""
    raw = F.col("value") / 200
    score = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 89 == 0, raw)
    return score.otherwise(F.least(F.lit(1.0), raw)).alias("predicted_probability")


def event_scores(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").cast("string").alias("stop_event_key"), event_score())


def held_out_scores(events: DataFrame, test_from: str, threshold: float, model: tuple[str, str]) -> DataFrame:
    """Scored stops as a model run hands them over: all stops with a known outcome, in two splits.

    Some station names are missing, as in scores that carry no station attributes.
    """
    named = F.when(F.col("event_id") % 17 != 0, True).alias("named")
    stops = stop_events(events, also=(event_score(), named))
    delay = delay_minutes(F.col("departure_planned_time"), F.col("departure_change_time"))
    day = F.to_date("time")
    split = F.when(day >= F.lit(test_from).cast("date"), "test").otherwise("validation")
    known = stops.filter(F.col("departure_planned_time").isNotNull() & ~F.col("is_canceled"))
    return known.select(
        F.col("id").alias("stop_event_key"),
        F.col("train_line_ride_id").alias("journey_id"),
        day.alias("service_date"),
        F.col("eva").alias("station_id"),
        F.when(F.col("named"), F.col("station_name")).alias("station_name"),
        "train_type",
        "line_number",
        F.concat_ws("-", "train_type", "train_number", F.coalesce("line_number", F.lit("none"))).alias(
            "train_service_key"
        ),
        service_class(F.col("train_type")).alias("service_class"),
        split.alias("prediction_split"),
        F.hour("time").alias("hour_of_day"),
        F.lit(model[0]).alias("model_name"),
        F.lit(model[1]).alias("model_version"),
        F.lit(threshold).alias("selected_threshold"),
        "predicted_probability",
        (delay >= SEVERE_MINUTES).alias("actual_is_departure_severe_delay"),
    )
