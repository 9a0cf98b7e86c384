"""Layer tables and hand-off files in Parquet."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from delaymill.config import STOP_EVENT_COLUMNS, STOP_EVENT_TYPES
from delaymill.operators.quality import assert_clean

MONTH_FILE = r"/(data-\d{4}-\d{2}\.parquet)(?:/[^/]*)?$"


def read_stop_events(spark: SparkSession, *paths: str) -> DataFrame:
    """The whitelisted columns of one or more month files, with the month file each row came from.

    The schema is fixed, not inferred; of every path only the column names are looked up, as a missing column
    would read as null. A month file may be a single file or a folder of that name.
    """
    for path in paths:
        names = spark.read.parquet(path).columns
        missing = [c for c in STOP_EVENT_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"missing source columns: {missing}")
    rows = spark.read.schema(", ".join(f"`{c}` {kind}" for c, kind in STOP_EVENT_TYPES.items())).parquet(*paths)
    month_file = F.regexp_extract(F.col("_metadata.file_path"), MONTH_FILE, 1)
    return rows.select(
        *STOP_EVENT_COLUMNS, F.when(month_file != "", month_file).otherwise(F.col("_metadata.file_name")).alias("source_file")
    )


def save_frame(df: DataFrame, path: str, partition_by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Overwrite a Parquet folder; hot partition values are split over several writers.

    With ``order`` the files hold consecutive, sorted key ranges (in every partition), so that a reader of a narrow range skips the others by
    the statistics of files and row groups.
    """
    _laid_out(df, partition_by, order).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _laid_out(df: DataFrame, partition_by: str | None, order: tuple[str, ...]) -> DataFrameWriter:
    keys = [*([partition_by] if partition_by else []), *order]
    if order:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    elif partition_by:
        df = df.hint("rebalance", partition_by)
    return df.write.partitionBy(partition_by) if partition_by else df.write


def save_layer_table(
    df: DataFrame,
    root: str,
    layer: str,
    table: str,
    partition_by: str | None = None,
    order: tuple[str, ...] = (),
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Create or replace ``layer.table``, an external Parquet table; every version has a folder of its own below ``root``.

    A version is written and validated (``check`` gives rules and violations) before the table's location switches to it. Until then, and if either
    fails, the table shows the version before, of which the files are kept; older ones are removed after the switch. A changed schema, and
    partitions in a Hive catalog, need a new table, which takes the place of the old one in the catalog without touching files.
    """
    spark, name = df.sparkSession, f"{layer}.{table}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    folder = f"{root}/{layer}/{table}"
    version = f"{folder}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _laid_out(df, partition_by, order).parquet(version)
    written = spark.read.schema(df.schema).parquet(version).select(*df.columns)
    if check is not None:
        assert_clean(check(written))
    before = _location(spark, name)
    partitioned = [partition_by] if partition_by else []
    last = [f for f in written.schema.fields if f.name not in partitioned] + [written.schema[c] for c in partitioned]
    same = before is not None and [(f.name, f.dataType) for f in spark.table(name).schema.fields] == [(f.name, f.dataType) for f in last]
    in_hive = spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive"
    if same and not (partition_by and in_hive):  # whose partitions would keep their old places
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last)
        by = f" PARTITIONED BY (`{partition_by}`)" if partition_by else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet{by} LOCATION '{version}'")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)
    _remove_versions(spark, folder, keep={version.rsplit("/", 1)[1], (before or "").rstrip("/").rsplit("/", 1)[-1]})
    return spark.table(name).select(*df.columns)


def _location(spark: SparkSession, name: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    return spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first().data_type


def _remove_versions(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Versions written before those that are kept; one that is being written is newer and stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if status.getPath().getName() < min(k for k in keep if k):
            files.delete(status.getPath(), True)


def write_report(spark: SparkSession, facts: dict, parts: dict[str, DataFrame], path: str) -> None:
    """A report of any length as a folder on shared storage: ``facts`` (run parameters) as one JSON line, each part as JSON lines.

    Parts are written where their rows are; nothing of them reaches the driver.
    """
    line = json.dumps(facts, ensure_ascii=False, default=str)
    spark.range(1).select(F.lit(line).alias("value")).write.mode("overwrite").text(f"{path}/facts")
    for name, part in parts.items():
        part.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/facts").first().value)


def read_part(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path}/{name}")
