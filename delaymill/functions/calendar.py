"""Date and time expressions. None of them depends on the session time zone for zone-less input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the days, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def minute_boundaries(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end``: 10:00:50 to 10:01:10 is one."""

    def minute_of_day(c: Column) -> Column:
        return F.hour(c) * 60 + F.minute(c)

    days = F.datediff(F.to_date(end), F.to_date(start))
    return (days * 1440 + minute_of_day(end) - minute_of_day(start)).cast("int")


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def iso_weekday(day: Column) -> Column:
    return (F.weekday(day) + 1).cast("int")


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def date_attributes(day: Column) -> dict[str, Column]:
    weekday = iso_weekday(day)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "week_of_year": F.weekofyear(day),
        "day_of_week": weekday,
        "day_name": F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(day)),
        "is_weekend": weekday >= 6,
    }


def time_band(hour: Column) -> Column:
    rush = hour.between(6, 9) | hour.between(16, 19)
    return F.when(rush, "peak").otherwise("off_peak")


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00-%02d:59", hour, hour)


def month_start_of_file(name: Column) -> Column:
    token = F.regexp_extract(name, r"(\d{4}-\d{2})\.parquet$", 1)
    return F.to_date(F.concat(token, F.lit("-01")))
