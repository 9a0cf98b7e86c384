"""Readers for the small teaching formats: CSV, CSV matrix, XML coverage rows, text matrix, calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.operators.ranking import rank_rows


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A square table with row names in its first column, as (row_name, column_name, value) rows."""
    wide = spark.read.option("header", True).csv(path)
    first, *rest = wide.columns
    clean = wide.select(F.trim(F.col(f"`{first}`")).alias("row_name"), *[
        F.trim(F.col(f"`{c}`")).cast("int").alias(c.strip()) for c in rest
    ])
    return clean.unpivot("row_name", [c.strip() for c in rest], "column_name", "value")


def read_coverage_xml(spark: SparkSession, path: str, row_tag: str = "Cover") -> DataFrame:
    """Attributes of each repeated element as (day, shift, skill, required)."""
    schema = "_Day int, _ShiftType string, _Skill string, _Required int"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(
        F.col("_Day").alias("day"),
        F.col("_ShiftType").alias("shift"),
        F.col("_Skill").alias("skill"),
        F.col("_Required").alias("required"),
    )


def machine_times(lines: DataFrame) -> DataFrame:
    """(machine, time) pairs of lines such as ``0 45 1 31``; a two-number line is a size header."""
    tokens = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("tokens") / 2 - 1).cast("int")),
        lambda i: F.struct(
            F.get("tokens", i * 2).cast("int").alias("machine"),
            F.get("tokens", i * 2 + 1).cast("int").alias("time"),
        ),
    )
    body = lines.withColumn("tokens", tokens).filter(F.size("tokens") > 2)
    keep = [c for c in lines.columns if c != "value"]
    return body.select(*keep, F.explode(pairs).alias("pair")).select(*keep, "pair.machine", "pair.time")


def read_machine_times(spark: SparkSession, path: str) -> DataFrame:
    """(job, machine, time) rows of a text matrix; jobs are numbered from 0 in file order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    body = lines.filter(F.size(F.split(F.trim("value"), r"\s+")) > 2)
    numbered = rank_rows(body, [], [F.col("file").asc(), F.col("block").asc(), F.col("line").asc()], "job")
    return machine_times(numbered.select((F.col("job") - 1).cast("int").alias("job"), "value"))


def calendar_days(bounds: DataFrame) -> DataFrame:
    """One row per day of each (start, end) row, with its index."""
    days = F.sequence(F.col("start"), F.col("end"), F.expr("interval 1 day"))
    return bounds.select(F.posexplode(days).alias("day_index", "calendar_date"))
