"""Month files: labels, bounds and the order in which other months are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.functions.calendar import month_start_of_file

# Fixed value: how many neighbouring months are searched for a disrupted week.
SEARCHED_MONTHS = 4


def month_version(name: Column) -> Column:
    return F.concat(F.lit("monthly_processed_data/"), name, F.lit("@main"))


def month_labels(files: DataFrame, base_url: str = "") -> DataFrame:
    """Bounds, location and version of every named month file."""
    start = month_start_of_file(F.col("file_name"))
    return files.select(
        "file_name",
        start.alias("month_start"),
        F.last_day(start).alias("month_end"),
        F.concat(F.lit(base_url), F.col("file_name")).alias("source_url"),
        month_version(F.col("file_name")).alias("source_version"),
    )


def candidate_months(files: DataFrame, baseline: str, n: int = SEARCHED_MONTHS) -> DataFrame:
    """The ``n`` Parquet month files nearest to the baseline month, the baseline itself left out."""
    start = month_start_of_file(F.col("file_name"))
    base = month_start_of_file(F.lit(baseline))
    months_apart = (F.year(start) - F.year(base)) * 12 + F.month(start) - F.month(base)
    others = files.filter(F.col("file_name").endswith(".parquet") & (F.col("file_name") != baseline))
    ranked = others.withColumn("month_distance", F.abs(months_apart).cast("int"))
    return ranked.orderBy("month_distance", "file_name").limit(n)
