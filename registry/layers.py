"""Scope, cleaned star schema and feature layer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from delaymill.operators import features as feat
from delaymill.operators import layer_checks, quality, scope
from delaymill.operators import star_schema as star
from delaymill.session import scratch_path, spool
from delaymill.sources import layers, months
from delaymill.sources.sample_feed import SOURCE_FILE, load_events, stop_events
from registry.common import (
    ADDED_FILE,
    ADDED_PART,
    BASELINE_PART,
    FULL_BRONZE,
    HUB,
    LOADED_AT,
    SCOPE,
    WEEK,
    feed,
    printed,
    query,
    stops_cte,
    with_ctes,
)

STOPS = stops_cte()
RIDES = stops_cte("rides", recurring=True)

# ---- month files -------------------------------------------------------------------------------

_ORDER_FILES = """files AS (
  SELECT DISTINCT 'data-' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS file_name FROM orders)"""


def _order_files(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    token = F.date_format(F.to_date("o_orderdate"), "yyyy-MM")
    return orders.select(F.concat(F.lit("data-"), token, F.lit(".parquet")).alias("file_name")).distinct()


@query(
    "month_labels",
    with_ctes(
        _ORDER_FILES,
        "bounds AS (SELECT file_name, strptime(substr(file_name, 6, 7), '%Y-%m') AS first FROM files)",
        final=printed(
            """SELECT file_name, first AS month_start, first + INTERVAL 1 MONTH - INTERVAL 1 DAY AS month_end,
            'feed/' || file_name AS source_url,
            'monthly_processed_data/' || file_name || '@main' AS source_version FROM bounds""",
            dates="month_start month_end",
        ),
    ),
)
def month_labels(spark, folder):
    return months.month_labels(_order_files(spark, folder), "feed/")


@query(
    "candidate_months",
    with_ctes(
        _ORDER_FILES,
        final="""SELECT file_name, CAST(abs(date_diff('month', DATE '1996-06-01',
            CAST(strptime(substr(file_name, 6, 7), '%Y-%m') AS DATE))) AS INTEGER) AS month_distance
            FROM files WHERE file_name <> 'data-1996-06.parquet' ORDER BY 2, 1 LIMIT 4""",
    ),
)
def candidate_months(spark, folder):
    return months.candidate_months(_order_files(spark, folder), "data-1996-06.parquet")


# ---- scope ---------------------------------------------------------------------------------------


def _recurring(spark, folder):
    return stop_events(load_events(spark, folder), recurring_rides=True)


def _bronze(spark, folder):
    rides = _recurring(spark, folder)
    return scope.bronze_events([(rides, BASELINE_PART), (rides, ADDED_PART)], SCOPE, LOADED_AT)


_LINEAGE = f"""'{SCOPE.selected_month}' AS selected_month, '{HUB}' AS selected_hub,
    '{json.dumps(list(SCOPE.required_columns))}' AS required_columns_json,
    '{SCOPE.complete_journey_rule}' AS complete_journey_rule, 'q1' AS extraction_query_version,
    'v1' AS scope_version, TIMESTAMP '{LOADED_AT}' AS loaded_at_utc, TIMESTAMP '{LOADED_AT}' AS extraction_timestamp_utc"""
_SCOPED = f"""scoped AS (
  SELECT *, '{SOURCE_FILE}' AS source_file, '{BASELINE_PART.source_version}' AS source_version,
         '2024-01' AS scope_label, '2024-01' AS source_month, 'baseline_month' AS scope_slice,
         CAST(NULL AS DATE) AS scope_week_start_date, CAST(NULL AS DATE) AS scope_week_end_date, {_LINEAGE}
  FROM rides r WHERE EXISTS (
    SELECT 1 FROM rides h WHERE h.train_line_ride_id = r.train_line_ride_id AND h.station_name = '{HUB}')
  UNION ALL BY NAME
  SELECT *, '{ADDED_FILE}' AS source_file, '{ADDED_PART.source_version}' AS source_version,
         '{WEEK[0]}:{WEEK[1]}' AS scope_label, CAST(NULL AS VARCHAR) AS source_month,
         'added_disrupted_week' AS scope_slice, DATE '{WEEK[0]}' AS scope_week_start_date,
         DATE '{WEEK[1]}' AS scope_week_end_date, {_LINEAGE}
  FROM rides r WHERE EXISTS (
    SELECT 1 FROM rides h WHERE h.train_line_ride_id = r.train_line_ride_id AND h.station_name = '{HUB}'
      AND h.time >= DATE '{WEEK[0]}' AND h.time < DATE '2024-01-29'))"""
_STOP_STAMPS = "time arrival_planned_time arrival_change_time departure_planned_time departure_change_time"


@query(
    "hub_journeys",
    with_ctes(
        STOPS,
        final=printed(
            f"""SELECT * FROM stops WHERE train_line_ride_id IN
            (SELECT train_line_ride_id FROM stops WHERE station_name = '{HUB}')""",
            stamps=_STOP_STAMPS,
        ),
    ),
)
def hub_journeys(spark, folder):
    return scope.scope_journeys(stop_events(load_events(spark, folder)), HUB)


def month_files(spark, folder) -> list[str]:
    """The feed as two month files in the scratch folder: odd events fall into February."""
    january = F.col("event_id") % 2 == 0
    events = load_events(spark, folder)
    later = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL '31' DAY"))
    parts = {"data-2024-01.parquet": events.filter(january), ADDED_FILE: later.filter(~january)}
    root = scratch_path(spark, "months")
    for name, rows in parts.items():
        layers.save_frame(stop_events(rows), f"{root}/{name}")
    return [f"{root}/{name}" for name in parts]


@query(
    "month_files_scope",
    with_ctes(
        """month_events AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 31 DAY END AS ts)
             FROM events)""",
        STOPS.replace("FROM events", "FROM month_events"),
        final=printed(
            f"""SELECT *, CASE WHEN month(time) = 1 THEN 'data-2024-01.parquet' ELSE '{ADDED_FILE}' END AS source_file
            FROM stops WHERE train_line_ride_id IN
            (SELECT train_line_ride_id FROM stops WHERE station_name = '{HUB}')""",
            stamps=_STOP_STAMPS,
        ),
    ),
)
def month_files_scope(spark, folder):
    return scope.scope_journeys(layers.read_stop_events(spark, *month_files(spark, folder)), HUB)


@query(
    "scope_union",
    with_ctes(
        RIDES,
        _SCOPED,
        final=printed(
            "SELECT * FROM scoped",
            dates="scope_week_start_date scope_week_end_date",
            stamps=f"{_STOP_STAMPS} loaded_at_utc extraction_timestamp_utc",
        ),
    ),
)
def scope_union(spark, folder):
    return _bronze(spark, folder)


@query(
    "station_reference",
    with_ctes(
        RIDES,
        _SCOPED,
        final=printed(
            """SELECT DISTINCT eva AS station_id_raw, station_name AS station_name_raw,
            xml_station_name AS xml_station_name_raw, source_file, loaded_at_utc FROM scoped""",
            stamps="loaded_at_utc",
        ),
    ),
)
def station_reference(spark, folder):
    return scope.station_reference(_bronze(spark, folder))


@query(
    "ingestion_manifest",
    with_ctes(
        RIDES,
        _SCOPED,
        final=printed(
            """SELECT scope_slice, source_file, any_value(source_version) AS source_version,
            any_value(scope_label) AS scope_label, any_value(scope_week_start_date) AS scope_week_start_date,
            any_value(scope_week_end_date) AS scope_week_end_date, any_value(scope_version) AS scope_version,
            any_value(extraction_query_version) AS extraction_query_version,
            any_value(selected_month) AS selected_month, any_value(selected_hub) AS selected_hub,
            any_value(required_columns_json) AS required_columns_json,
            any_value(complete_journey_rule) AS complete_journey_rule,
            any_value(extraction_timestamp_utc) AS extraction_timestamp_utc, count(*) AS row_count
            FROM scoped GROUP BY scope_slice, source_file""",
            dates="scope_week_start_date scope_week_end_date",
            stamps="extraction_timestamp_utc",
        ),
    ),
)
def ingestion_manifest(spark, folder):
    return scope.ingestion_manifest(_bronze(spark, folder))


@query(
    "bronze_summary",
    with_ctes(
        RIDES,
        _SCOPED,
        "labelled AS (SELECT *, unnest([scope_slice, 'all']) AS s FROM scoped)",
        final=printed(
            f"""SELECT s AS scope_slice, CASE WHEN s = 'all' THEN 'all' ELSE any_value(source_file) END AS source_file,
            min(CAST(time AS DATE)) AS min_service_date, max(CAST(time AS DATE)) AS max_service_date,
            count(*) AS row_count, count(*) FILTER (WHERE station_name = '{HUB}') AS hub_row_count,
            count(DISTINCT train_line_ride_id) AS journey_count FROM labelled GROUP BY s""",
            dates="min_service_date max_service_date",
        ),
    ),
)
def bronze_summary(spark, folder):
    return scope.bronze_summary(_bronze(spark, folder), HUB)


@query(
    "layer_report",
    with_ctes(
        RIDES,
        _SCOPED,
        "labelled AS (SELECT *, unnest([scope_slice, 'all']) AS s FROM scoped)",
        final=f"""SELECT s AS scope_slice, strftime(min(time), '%Y-%m-%d') AS min_service_date, strftime(max(time), '%Y-%m-%d') AS max_service_date,
        count(*) AS row_count, count(*) FILTER (WHERE station_name = '{HUB}') AS hub_row_count, 'v1' AS scope_version FROM labelled GROUP BY s""",
    ),
)
def layer_report(spark, folder):
    """The report of a run as JSON on shared storage: its parts are written where their rows are, and read back with its facts."""
    path = scratch_path(spark, "layer_report")
    layers.write_report(spark, {"scope_version": SCOPE.scope_version}, {"slices": scope.bronze_summary(_bronze(spark, folder), HUB)}, path)
    schema = "scope_slice string, min_service_date string, max_service_date string, row_count long, hub_row_count long"
    facts = layers.read_facts(spark, path)
    return layers.read_part(spark, path, "slices", schema).withColumn("scope_version", F.lit(facts["scope_version"]))


_WEEKS = f"""weeks AS (
  SELECT CAST(date_trunc('week', time) AS DATE) AS week_start_date, count(*) AS hub_stop_count,
         count(*) FILTER (WHERE delay_in_min >= 15 OR is_canceled) AS severe_or_cancel_count
  FROM stops WHERE station_name = '{HUB}' GROUP BY 1),
full_weeks AS (
  SELECT '{SOURCE_FILE}' AS source_file, week_start_date, week_start_date + 6 AS week_end_date, hub_stop_count,
         severe_or_cancel_count, severe_or_cancel_count / hub_stop_count AS severe_or_cancel_share
  FROM weeks WHERE week_start_date >= DATE '2024-01-01' AND week_start_date + 6 <= DATE '2024-01-31')"""


@query(
    "disrupted_weeks",
    with_ctes(
        STOPS,
        _WEEKS,
        final=printed(
            "SELECT * FROM full_weeks", dates="week_start_date week_end_date", doubles="severe_or_cancel_share"
        ),
    ),
)
def disrupted_weeks(spark, folder):
    return scope.disrupted_weeks(feed(spark, folder), HUB)


@query(
    "disrupted_week_pick",
    with_ctes(
        STOPS,
        _WEEKS,
        final=printed(
            """SELECT * FROM full_weeks ORDER BY severe_or_cancel_count DESC, severe_or_cancel_share DESC,
            hub_stop_count DESC, week_start_date LIMIT 1""",
            dates="week_start_date week_end_date",
            doubles="severe_or_cancel_share",
        ),
    ),
)
def disrupted_week_pick(spark, folder):
    return scope.pick_week(scope.disrupted_weeks(feed(spark, folder), HUB))


@query(
    "hub_weeks_sql",
    with_ctes(
        STOPS,
        _WEEKS,
        final=printed(
            "SELECT week_start_date, hub_stop_count, severe_or_cancel_count FROM full_weeks", dates="week_start_date"
        ),
    ),
)
def hub_weeks_sql(spark, folder):
    from datetime import date

    return scope.hub_weeks_sql(feed(spark, folder), HUB, date(2024, 1, 1), date(2024, 1, 31))


# ---- cleaned star schema -------------------------------------------------------------------------

SILVER = """station_dim AS (
  SELECT CAST(row_number() OVER (ORDER BY eva NULLS LAST) AS INTEGER) AS station_key, eva AS station_id,
         min(station_name) AS station_name, min(xml_station_name) AS xml_station_name
  FROM bronze GROUP BY eva),
service_dim AS (
  SELECT CAST(row_number() OVER (ORDER BY train_type NULLS LAST, train_number NULLS LAST,
         line_number NULLS LAST) AS INTEGER) AS train_service_key, *,
         CASE WHEN train_type IN ('ICE', 'IC') THEN 'long_distance' WHEN train_type = 'RE' THEN 'regional'
              WHEN train_type = 'S' THEN 'local_urban' ELSE 'other' END AS service_class
  FROM (SELECT DISTINCT train_type, train_number, line_number FROM bronze)),
stop_fact AS (
  SELECT b.id AS stop_event_key, CAST(strftime(b.time, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(hour(b.time) AS INTEGER) AS hour_key, s.station_key, t.train_service_key,
         CAST(b.time AS DATE) AS service_date, b.train_line_ride_id AS journey_id,
         b.train_line_station_num AS stop_sequence, b.final_destination_station,
         b.delay_in_min AS provider_delay_in_min, b.time AS provider_event_ts,
         b.arrival_planned_time AS planned_arrival_ts, b.arrival_change_time AS actual_arrival_ts,
         b.departure_planned_time AS planned_departure_ts, b.departure_change_time AS actual_departure_ts,
         CAST(date_diff('minute', b.arrival_planned_time, b.arrival_change_time) AS INTEGER) AS arrival_delay_min,
         CAST(date_diff('minute', b.departure_planned_time, b.departure_change_time) AS INTEGER) AS departure_delay_min,
         b.is_canceled AS is_cancellation,
         b.is_canceled AND b.arrival_planned_time IS NOT NULL AS is_arrival_cancelled,
         b.is_canceled AND b.departure_planned_time IS NOT NULL AS is_departure_cancelled,
         b.source_file, b.loaded_at_utc
  FROM bronze b JOIN station_dim s ON s.station_id = b.eva
  JOIN service_dim t ON t.train_type = b.train_type AND t.train_number = b.train_number
   AND t.line_number IS NOT DISTINCT FROM b.line_number)"""
GOLD = """wide AS (
  SELECT f.*, s.station_id, s.station_name, t.train_type, t.train_number, t.line_number, t.service_class,
         f.service_date AS calendar_date, CAST(year(f.service_date) AS INTEGER) AS year,
         CAST(month(f.service_date) AS INTEGER) AS month, CAST(week(f.service_date) AS INTEGER) AS week_of_year,
         CAST(isodow(f.service_date) AS INTEGER) AS day_of_week, dayname(f.service_date) AS day_name,
         dayname(f.service_date) IN ('Saturday', 'Sunday') AS is_weekend, f.hour_key AS hour_of_day,
         CASE WHEN f.hour_key IN (6, 7, 8, 9, 16, 17, 18, 19) THEN 'peak' ELSE 'off_peak' END AS time_band,
         f.departure_delay_min - f.arrival_delay_min AS delay_change_min,
         coalesce(f.departure_delay_min, f.arrival_delay_min, f.provider_delay_in_min) AS event_delay_min,
         f.departure_delay_min >= 15 AS is_departure_severe_delay, NOT f.is_cancellation AS is_active_stop,
         f.planned_arrival_ts IS NOT NULL AS has_arrival_time_data,
         f.planned_departure_ts IS NOT NULL AS has_departure_time_data
  FROM stop_fact f JOIN station_dim s USING (station_key) JOIN service_dim t USING (train_service_key)),
gold AS (
  SELECT *, event_delay_min IS NOT NULL AS has_delay_measurement, event_delay_min > 0 AS is_delayed,
         event_delay_min >= 15 AS is_severe_delay, event_delay_min >= 30 AS is_extreme_delay,
         CASE WHEN event_delay_min IS NULL THEN 'unknown' WHEN event_delay_min < 1 THEN 'early_or_on_time'
              WHEN event_delay_min < 6 THEN 'minor' WHEN event_delay_min < 15 THEN 'medium'
              WHEN event_delay_min < 30 THEN 'severe' ELSE 'extreme' END AS delay_bucket
  FROM wide)"""
_FACT_STAMPS = (
    "provider_event_ts planned_arrival_ts actual_arrival_ts planned_departure_ts actual_departure_ts loaded_at_utc"
)
_BASE = (STOPS, FULL_BRONZE, SILVER)
_GOLD = (*_BASE, GOLD)


@query("dim_station", with_ctes(*_BASE, final="SELECT * FROM station_dim"))
def dim_station(spark, folder):
    return star.dim_station(feed(spark, folder))


@query("dim_train_service", with_ctes(*_BASE, final="SELECT * FROM service_dim"))
def dim_train_service(spark, folder):
    return star.dim_train_service(feed(spark, folder))


@query(
    "dim_date",
    with_ctes(
        STOPS,
        final=printed(
            """SELECT DISTINCT CAST(strftime(time, '%Y%m%d') AS INTEGER) AS date_key, CAST(time AS DATE) AS calendar_date,
            CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
            CAST(week(time) AS INTEGER) AS week_of_year, CAST(isodow(time) AS INTEGER) AS day_of_week,
            dayname(time) AS day_name, isodow(time) > 5 AS is_weekend FROM stops""",
            dates="calendar_date",
        ),
    ),
)
def dim_date(spark, folder):
    return star.dim_date(feed(spark, folder))


@query(
    "dim_hour",
    with_ctes(
        STOPS,
        final="""SELECT h AS hour_key, h AS hour_of_day,
        CASE WHEN h IN (6, 7, 8, 9, 16, 17, 18, 19) THEN 'peak' ELSE 'off_peak' END AS time_band
        FROM (SELECT DISTINCT CAST(hour(time) AS INTEGER) AS h FROM stops)""",
    ),
)
def dim_hour(spark, folder):
    return star.dim_hour(feed(spark, folder))


def layer_frames(bronze):
    stations, services = star.keyed_dimensions(bronze)
    fact = star.fact_stop_event(bronze, stations, services)
    return stations, services, fact, feat.feature_stop_event(fact, stations, services)


def gold_frame(spark, folder):
    return layer_frames(feed(spark, folder))[3]


@query(
    "fact_stop_event",
    with_ctes(
        *_BASE,
        final=printed(
            "SELECT *, departure_delay_min - arrival_delay_min AS delay_change_min FROM stop_fact",
            dates="service_date",
            stamps=_FACT_STAMPS,
        ),
    ),
)
def fact_stop_event(spark, folder):
    return layer_frames(feed(spark, folder))[2]


@query(
    "feature_stop_event",
    with_ctes(
        *_GOLD,
        final=printed(f"SELECT {', '.join(feat.FEATURE_COLUMNS)} FROM gold", dates="service_date calendar_date"),
    ),
)
def feature_stop_event(spark, folder):
    return gold_frame(spark, folder)


@query("delay_buckets", with_ctes(*_GOLD, final="SELECT delay_bucket, count(*) AS events FROM gold GROUP BY 1"))
def delay_buckets(spark, folder):
    return gold_frame(spark, folder).groupBy("delay_bucket").agg(F.count(F.lit(1)).alias("events"))


STATION_HOUR = """station_hours AS (
  SELECT station_key, date_key, hour_key, any_value(station_id) AS station_id,
         any_value(station_name) AS station_name, any_value(calendar_date) AS calendar_date,
         any_value(year) AS year, any_value(month) AS month, any_value(week_of_year) AS week_of_year,
         any_value(day_of_week) AS day_of_week, any_value(day_name) AS day_name,
         any_value(is_weekend) AS is_weekend, any_value(hour_of_day) AS hour_of_day,
         any_value(time_band) AS time_band, count(*) AS stop_event_count,
         count(*) FILTER (WHERE has_delay_measurement) AS measured_delay_event_count,
         count(*) FILTER (WHERE is_delayed) AS delayed_event_count,
         count(*) FILTER (WHERE is_severe_delay) AS severe_delay_event_count,
         count(*) FILTER (WHERE is_extreme_delay) AS extreme_delay_event_count,
         count(*) FILTER (WHERE is_cancellation) AS cancellation_event_count,
         count(*) FILTER (WHERE has_arrival_time_data) AS arrival_time_data_count,
         count(*) FILTER (WHERE has_departure_time_data) AS departure_time_data_count,
         avg(event_delay_min) AS avg_event_delay_min, max(event_delay_min) AS max_event_delay_min
  FROM gold GROUP BY station_key, date_key, hour_key)"""


@query(
    "station_hour",
    with_ctes(
        *_GOLD,
        STATION_HOUR,
        final=printed(
            """SELECT *, delayed_event_count / nullif(measured_delay_event_count, 0) AS pct_delayed,
            cancellation_event_count / stop_event_count AS pct_cancellation,
            severe_delay_event_count / nullif(measured_delay_event_count, 0) AS pct_severe_delay FROM station_hours""",
            dates="calendar_date",
            doubles="avg_event_delay_min pct_delayed pct_cancellation pct_severe_delay",
        ),
    ),
)
def station_hour(spark, folder):
    return feat.station_hour(gold_frame(spark, folder))


@query(
    "aggregate_mismatch",
    with_ctes(
        *_GOLD,
        final="""SELECT count(*) AS station_hours, CAST(0 AS BIGINT) AS mismatches
        FROM (SELECT DISTINCT station_key, date_key, hour_key FROM gold)""",
    ),
)
def aggregate_mismatch(spark, folder):
    gold = gold_frame(spark, folder)
    stored = spool(feat.station_hour(gold), "station_hour")
    wrong = feat.station_hour_mismatches(gold, stored).agg(F.count(F.lit(1)).alias("mismatches"))
    return stored.agg(F.count(F.lit(1)).alias("station_hours"), F.any_value(wrong.scalar()).alias("mismatches"))


@query(
    "layer_counts",
    with_ctes(
        *_GOLD,
        final="""SELECT 'bronze_rows' AS measure, count(*) AS value FROM bronze
        UNION ALL SELECT 'bronze_stations', count(DISTINCT eva) FROM bronze
        UNION ALL SELECT 'silver_rows', count(*) FROM stop_fact
        UNION ALL SELECT 'station_rows', count(*) FROM station_dim
        UNION ALL SELECT 'gold_rows', count(*) FROM gold
        UNION ALL SELECT 'station_hour_keys', count(*) FROM
            (SELECT DISTINCT station_key, date_key, hour_key FROM gold)""",
    ),
)
def layer_counts(spark, folder):
    bronze = feed(spark, folder)
    stations, _, fact, gold = layer_frames(bronze)
    return feat.layer_counts(bronze, fact, gold, stations)


_BROKEN = "CAST(stop_event_key AS BIGINT) % 10 = 3"
_CHECKS = {
    "bronze holds rows": "CASE WHEN n_bronze = 0 THEN 1 ELSE 0 END",
    "bronze holds the hub": "CASE WHEN n_hub = 0 THEN 1 ELSE 0 END",
    "manifest counts every bronze row": "abs(n_bronze - n_manifest)",
    "silver keeps every bronze row": "abs(n_bronze - n_fact)",
    "every station id has one row": "abs(n_stations - n_eva)",
    "gold keeps every silver row": "abs(n_gold - n_fact)",
    "one row per station and hour": "abs(n_hours - n_keys)",
    "station hours count every row": "abs(n_hour_events - n_gold)",
    "station hours match their events": "n_wrong",
}


@query(
    "layer_checks",
    with_ctes(
        *_GOLD,
        f"""hour_keys AS (SELECT station_key, date_key, hour_key, count(*) AS n, count(*) FILTER (WHERE NOT {_BROKEN}) AS kept FROM gold GROUP BY 1, 2, 3),
        facts AS (
          SELECT (SELECT count(*) FROM bronze) AS n_bronze, (SELECT count(*) FROM bronze WHERE station_name = '{HUB}') AS n_hub,
                 (SELECT count(DISTINCT eva) FROM bronze) AS n_eva, (SELECT count(*) FROM station_dim) AS n_stations,
                 (SELECT count(*) FROM stop_fact) AS all_facts, (SELECT count(*) FROM gold) AS n_gold,
                 (SELECT count(*) FROM gold WHERE NOT {_BROKEN}) AS kept_gold, (SELECT count(*) FROM hour_keys) AS n_keys,
                 (SELECT count(*) FROM hour_keys WHERE kept > 0) AS kept_keys, (SELECT count(*) FROM hour_keys WHERE kept < n) AS changed_keys),
        cases AS (
          SELECT 'whole' AS layers, n_bronze AS n_manifest, all_facts AS n_fact, n_keys AS n_hours, n_gold AS n_hour_events, 0 AS n_wrong, * FROM facts
          UNION ALL
          SELECT 'broken', n_bronze - (SELECT count(*) FROM bronze WHERE eva = '3'), kept_gold, kept_keys, kept_gold, changed_keys, * FROM facts)""",
        final=" UNION ALL ".join(f"SELECT layers, '{rule}' AS rule, CAST({sql} AS BIGINT) AS violations FROM cases" for rule, sql in _CHECKS.items()),
    ),
)
def layer_checks_query(spark, folder):
    """The checks of a run on whole layers, and on layers that lost rows between bronze and silver and in the station hours."""
    bronze = feed(spark, folder)
    stations, _, fact, gold = layer_frames(bronze)
    gold = spool(gold, "gold")
    manifest = bronze.groupBy("eva").agg(F.count(F.lit(1)).alias("row_count"))
    lost = F.col("stop_event_key").cast("long") % 10 == 3
    whole = layer_checks.layer_violations(bronze, manifest, fact, stations, gold, feat.station_hour(gold), HUB)
    broken = layer_checks.layer_violations(
        bronze, manifest.filter("eva <> '3'"), fact.filter(~lost), stations, gold, feat.station_hour(gold.filter(~lost)), HUB
    )
    return whole.withColumn("layers", F.lit("whole")).unionByName(broken.withColumn("layers", F.lit("broken")))


@query(
    "replaced_layer",
    with_ctes(
        *_BASE,
        final=printed(
            "SELECT service_date, count(*) AS events FROM stop_fact WHERE CAST(stop_event_key AS BIGINT) % 3 <> 0 GROUP BY 1", dates="service_date"
        ),
    ),
)
def replaced_layer(spark, folder):
    """A silver table written, replaced, and left as it is by a third version that fails its check; read from the catalog."""
    fact = spool(layer_frames(feed(spark, folder))[2], "fact")
    key = F.col("stop_event_key").cast("long")
    root, table = scratch_path(spark, "versions"), f"fact_{uuid.uuid4().hex[:12]}"

    def keyed(written):
        return quality.row_rules(written, {"every row has a date": F.col("service_date").isNull()})

    def save(rows):
        return layers.save_layer_table(rows, root, "layer_versions", table, "service_date", ("stop_event_key",), keyed)

    save(fact.filter(key % 2 == 0))
    stored = save(fact.filter(key % 3 != 0))
    try:
        save(fact.withColumn("service_date", F.when(key % 7 != 0, F.col("service_date"))))
    except ValueError:
        stored = spark.table(f"layer_versions.{table}")
    return stored.groupBy("service_date").agg(F.count(F.lit(1)).alias("events"))


@query(
    "ordered_fact_slice",
    with_ctes(
        *_BASE,
        final="""SELECT stop_event_key, station_key, hour_key FROM stop_fact WHERE station_key = 3 AND hour_key BETWEEN 6 AND 8""",
    ),
)
def ordered_fact_slice(spark, folder):
    """A narrow key range of the fact, read from files that hold consecutive ranges of it."""
    fact = layer_frames(feed(spark, folder))[2]
    stored = layers.save_frame(fact, scratch_path(spark, "ordered_fact"), order=("station_key", "hour_key"))
    return stored.filter("station_key = 3 AND hour_key BETWEEN 6 AND 8").select("stop_event_key", "station_key", "hour_key")


@query(
    "journey_sketches",
    with_ctes(
        RIDES,
        _SCOPED,
        final="""SELECT coalesce(scope_slice, 'all') AS scope_slice, count(DISTINCT train_line_ride_id) AS journeys, count(*) AS row_count,
        true AS estimate_is_near FROM scoped GROUP BY GROUPING SETS ((scope_slice), ())""",
    ),
)
def journey_sketches(spark, folder):
    """Exact journeys next to those of stored sketches, which are merged over slices that overlap; near means within four standard errors."""
    bronze = _bronze(spark, folder)
    stored = spool(scope.journey_sketches(bronze), "sketches")
    near = scope.sketched_journeys(stored, "scope_slice").unionByName(scope.sketched_journeys(stored).withColumn("scope_slice", F.lit("all")))
    counted = F.count_distinct("train_line_ride_id").alias("journeys")
    exact = bronze.groupBy("scope_slice").agg(counted).unionByName(bronze.agg(counted).withColumn("scope_slice", F.lit("all")))
    apart = F.abs(F.col("journey_estimate") - F.col("journeys"))
    return exact.join(near, "scope_slice").select(
        "scope_slice", "journeys", "row_count", (apart <= F.greatest(F.lit(1.0), 4 * scope.SKETCH_ERROR * F.col("journeys"))).alias("estimate_is_near")
    )


# months of the feed moved by whole weeks: February and March hold the same rows, June is far and the worst
_MOVED = {"2023-11": (-56, 5), "2023-12": (-28, 3), "2024-01": (0, 1), "2024-02": (35, 2), "2024-03": (63, 2), "2023-06": (-210, 1)}


def moved_months(spark, folder) -> list[str]:
    root, events = scratch_path(spark, "months"), load_events(spark, folder)
    for month, (days, part) in _MOVED.items():
        rows = events.filter(F.col("event_id") % part == 0).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL '{days}' DAY"))
        layers.save_frame(stop_events(rows), f"{root}/data-{month}.parquet", order=("station_name", "time"))
    return [f"{root}/data-{month}.parquet" for month in _MOVED]


_MOVED_SQL = " UNION ALL ".join(
    f"SELECT 'data-{month}.parquet' AS file, * REPLACE (ts + INTERVAL ({days}) DAY AS ts) FROM events WHERE event_id % {part} = 0"
    for month, (days, part) in _MOVED.items()
    if month not in ("2024-01", "2023-06")
)


@query(
    "multi_file_weeks",
    with_ctes(
        f"moved AS ({_MOVED_SQL})",
        STOPS.replace("FROM events", "FROM moved").replace("CAST(event_id AS VARCHAR) AS id", "CAST(event_id AS VARCHAR) AS id, file AS source_file"),
        f"""weeks AS (
          SELECT source_file, CAST(date_trunc('week', time) AS DATE) AS week_start_date, count(*) AS hub_stop_count,
                 count(*) FILTER (WHERE coalesce(delay_in_min, 0) >= 15 OR coalesce(is_canceled, false)) AS severe_or_cancel_count
          FROM stops WHERE station_name = '{HUB}' GROUP BY 1, 2),
        complete AS (
          SELECT *, week_start_date + 6 AS week_end_date, severe_or_cancel_count / hub_stop_count AS severe_or_cancel_share FROM weeks
          WHERE strftime(week_start_date, '%Y-%m') = substr(source_file, 6, 7) AND strftime(week_start_date + 6, '%Y-%m') = substr(source_file, 6, 7))""",
        final=printed(
            """SELECT source_file, week_start_date, week_end_date, hub_stop_count, severe_or_cancel_count, severe_or_cancel_share,
            row_number() OVER (ORDER BY severe_or_cancel_count DESC, severe_or_cancel_share DESC, hub_stop_count DESC, source_file, week_start_date) = 1
              AS is_picked FROM complete""",
            dates="week_start_date week_end_date",
            doubles="severe_or_cancel_share",
        ),
    ),
)
def multi_file_weeks(spark, folder):
    """Weeks of the four month files nearest to January, with the picked one; the first of two files with equal weeks is preferred."""
    weeks = spool(scope.search_weeks(spark, moved_months(spark, folder), SOURCE_FILE, HUB), "weeks")
    picked = scope.pick_week(weeks).select("source_file", "week_start_date", F.lit(True).alias("_picked"))
    return weeks.join(picked, ["source_file", "week_start_date"], "left").withColumn("is_picked", F.coalesce("_picked", F.lit(False))).drop("_picked")


@query(
    "saved_fact_by_date",
    with_ctes(
        *_BASE,
        final=printed(
            """SELECT service_date, count(*) AS events, max(departure_delay_min) AS worst FROM stop_fact
            WHERE service_date >= DATE '2024-01-10' GROUP BY 1""",
            dates="service_date",
        ),
    ),
)
def saved_fact_by_date(spark, folder):
    """The fact written as a date-partitioned table and read back with partition pruning."""
    fact = layer_frames(feed(spark, folder))[2]
    stored = layers.save_frame(fact, scratch_path(spark, "fact"), "service_date")
    recent = stored.filter(F.col("service_date") >= F.lit("2024-01-10").cast("date"))
    return recent.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("events"), F.max("departure_delay_min").alias("worst")
    )
