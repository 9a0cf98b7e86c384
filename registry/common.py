"""Registration, and the shared SQL of the sample feed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaymill.config import ADDED_SLICE, BASELINE_SLICE, ScopeConfig, ScopeSlice
from delaymill.sources.sample_feed import SOURCE_FILE, load_events, stop_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHIFT = 1e-9
LOADED_AT = "2024-02-01 06:00:00"
ADDED_FILE = "data-2024-02.parquet"
HUB = "Station 7"
WEEK = (date(2024, 1, 22), date(2024, 1, 28))

SCOPE = ScopeConfig(
    scope_version="v1",
    extraction_query_version="q1",
    selected_month="2024-01",
    selected_hub=HUB,
    source_file_name=SOURCE_FILE,
    source_version="monthly_processed_data/data-2024-01.parquet@main",
)
BASELINE_PART = ScopeSlice(BASELINE_SLICE, SOURCE_FILE, SCOPE.source_version)
ADDED_PART = ScopeSlice(ADDED_SLICE, ADDED_FILE, "monthly_processed_data/data-2024-02.parquet@main", WEEK[0])


def portable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates and timestamps as text and doubles rounded, so that both engines print the same values.

    The shift keeps values halfway between two printed ones away from the noise of summation order.
    """
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c + SHIFT, digits)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: portable(build(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def printed(body: str, dates: str = "", stamps: str = "", doubles: str = "", digits: int = 6) -> str:
    """Final SELECT with the same formatting as ``portable``."""
    changes = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    changes += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in stamps.split()]
    changes += [f"round({c} + {SHIFT}, {digits}) AS {c}" for c in doubles.split()]
    star = f"* REPLACE ({', '.join(changes)})" if changes else "*"
    return f"SELECT {star} FROM ({body})"


def with_ctes(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """All stop events with the lineage columns later layers need."""
    rows = stop_events(load_events(spark, folder))
    return rows.withColumns({
        "source_file": F.lit(SOURCE_FILE),
        "loaded_at_utc": F.lit(LOADED_AT).cast("timestamp_ntz"),
    })


def stops_cte(name: str = "stops", recurring: bool = False) -> str:
    ride = "CAST(user_id AS VARCHAR)" + ("" if recurring else " || '-' || strftime(ts, '%Y%m%d')")
    return f"""{name} AS (
  SELECT 'Station ' || k AS station_name, 'STATION ' || k AS xml_station_name, k AS eva,
         CAST(user_id % 40 AS VARCHAR) AS train_number,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 7 AS VARCHAR) END AS line_number,
         'Station ' || CAST(user_id % 100 AS VARCHAR) AS final_destination_station,
         d AS delay_in_min, ts AS time,
         event_type = 'error' AND event_id % 4 = 0 AS is_canceled,
         CASE event_type WHEN 'click' THEN 'ICE' WHEN 'view' THEN 'RE' WHEN 'purchase' THEN 'S'
                         WHEN 'signup' THEN 'IC' WHEN 'error' THEN 'XX' END AS train_type,
         {ride} AS train_line_ride_id,
         CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS train_line_station_num,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE m END AS arrival_planned_time,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE m + d * INTERVAL 1 MINUTE END AS arrival_change_time,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE m + INTERVAL 2 MINUTE END AS departure_planned_time,
         CASE WHEN event_id % 13 = 0 THEN NULL
              ELSE m + CAST(d + 2 + event_id % 3 - 1 AS INTEGER) * INTERVAL 1 MINUTE END AS departure_change_time,
         CAST(event_id AS VARCHAR) AS id
  FROM (SELECT *, json_extract_string(props, '$.k') AS k, CAST(floor(value / 4) AS INTEGER) - 5 AS d,
               date_trunc('minute', ts) AS m FROM events))"""


FULL_BRONZE = f"""bronze AS (
  SELECT *, '{SOURCE_FILE}' AS source_file, TIMESTAMP '{LOADED_AT}' AS loaded_at_utc FROM stops)"""
