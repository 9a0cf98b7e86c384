"""Delay, cancellation and service expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from delaymill.functions.calendar import minute_boundaries

# Train types of each service class.
SERVICE_CLASSES = {
    "long_distance": ("ICE", "IC", "EC", "NJ", "RJ", "TGV", "FLX"),
    "regional": ("RE", "RB", "IRE", "MEX"),
    "local_urban": ("S", "U", "STR", "Bus", "Tram"),
}
OTHER_SERVICE = "other"

# Minutes from which a delay is severe or extreme.
SEVERE_MINUTES = 15
EXTREME_MINUTES = 30

# Named delay ranges in minutes, both ends included; what fits none is "extreme".
DELAY_RANGES = {"minor": (1, 5), "medium": (6, 14), "severe": (15, 29)}


def service_class(train_type: Column) -> Column:
    label = F.lit(OTHER_SERVICE)
    for name, types in SERVICE_CLASSES.items():
        label = F.when(train_type.isin(*types), name).otherwise(label)
    return label


def delay_minutes(planned: Column, actual: Column) -> Column:
    return F.when(planned.isNotNull() & actual.isNotNull(), minute_boundaries(planned, actual))


def side_cancelled(cancelled: Column, planned: Column, actual: Column) -> Column:
    """Cancellation of the arrival or departure side, which must have some time at all."""
    return (planned.isNotNull() | actual.isNotNull()) & cancelled


def delay_bucket(delay: Column) -> Column:
    label = F.when(delay.isNull(), "unknown").when(delay <= 0, "early_or_on_time")
    for name, (low, high) in DELAY_RANGES.items():
        label = label.when(delay.between(low, high), name)
    return label.otherwise("extreme")


def delay_flags(delay: Column, departure_delay: Column) -> dict[str, Column]:
    return {
        "has_delay_measurement": delay.isNotNull(),
        "is_delayed": delay > 0,
        "is_severe_delay": delay >= SEVERE_MINUTES,
        "is_extreme_delay": delay >= EXTREME_MINUTES,
        "is_departure_severe_delay": departure_delay >= SEVERE_MINUTES,
        "delay_bucket": delay_bucket(delay),
    }


def share(part: Column, whole: Column) -> Column:
    """Ratio as a double; null when the denominator is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
