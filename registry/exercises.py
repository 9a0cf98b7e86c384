"""Teaching formats and exploratory cleaning, on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from delaymill.operators import explore
from delaymill.session import scratch_path
from delaymill.sources import exercise
from registry.common import FULL_BRONZE, feed, printed, query, stops_cte, with_ctes

# ---- sources -------------------------------------------------------------------------------------


@query(
    "csv_scan",
    """SELECT p_brand, count(*) AS parts, max(p_size) AS largest, round(sum(p_retailprice) + 1e-9, 4) AS price
    FROM part GROUP BY 1""",
)
def csv_scan(spark, folder):
    path = scratch_path(spark, "parts_csv")
    spark.read.parquet(f"{folder}/part.parquet").write.option("header", True).csv(path)
    parts = exercise.read_csv(spark, path)
    summed = parts.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest"), F.sum("p_retailprice").alias("price")
    )
    return summed.withColumn("price", F.round(F.col("price") + 1e-9, 4))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "matrix_unpivot",
    f"""SELECT n_name AS row_name, segment AS column_name,
    CAST(count(c_custkey) FILTER (WHERE c_mktsegment = segment) AS INTEGER) AS value
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey, (SELECT unnest({_SEGMENTS}) AS segment)
    GROUP BY 1, 2""",
)
def matrix_unpivot(spark, folder):
    """A nation by segment matrix, written with blanks after the commas, read back as rows."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    nations = spark.read.parquet(f"{folder}/nation.parquet")
    counts = customers.groupBy("c_nationkey").pivot("c_mktsegment", _SEGMENTS).agg(F.count(F.lit(1)))
    wide = nations.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("name"),
        *[F.concat(F.lit(" "), F.coalesce(s, F.lit(0)).cast("string")).alias(f" {s}") for s in _SEGMENTS],
    )
    path = scratch_path(spark, "matrix_csv")
    wide.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return exercise.read_csv_matrix(spark, path)


@query(
    "xml_coverage",
    """SELECT CAST(day(ts) AS INTEGER) AS day, event_type AS shift, 'K' || (user_id % 5) AS skill,
    CAST(count(*) AS INTEGER) AS required FROM events GROUP BY 1, 2, 3""",
)
def xml_coverage(spark, folder):
    """Coverage rows written as XML attributes and read back."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    rows = events.groupBy(
        F.dayofmonth("ts").alias("_Day"),
        F.col("event_type").alias("_ShiftType"),
        F.concat(F.lit("K"), (F.col("user_id") % 5).cast("string")).alias("_Skill"),
    ).agg(F.count(F.lit(1)).alias("_Required"))
    path = scratch_path(spark, "coverage_xml")
    rows.write.format("xml").option("rootTag", "CoverRequirements").option("rowTag", "Cover").save(path)
    return exercise.read_coverage_xml(spark, path)


@query(
    "machine_times",
    """SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, q) - 1 AS INTEGER) AS job,
      l_linenumber AS first_time, q AS second_time, l_suppkey AS third_time
    FROM (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_partkey, CAST(l_suppkey AS INTEGER) AS l_suppkey,
      CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
)
def machine_times(spark, folder):
    """Text lines of (machine, time) pairs, one line per item in the order of its keys, read back with job numbers."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("q", F.col("l_quantity").cast("bigint"))
    times = ["l_linenumber", "q", "l_suppkey"]
    pairs = [F.concat(F.lit(f"  {machine}  "), F.col(time).cast("string")) for machine, time in enumerate(times)]
    path = scratch_path(spark, "machine_text")
    ordered = items.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q")
    ordered.select(F.concat(*pairs).alias("value")).write.text(path)
    named = {0: "first_time", 1: "second_time", 2: "third_time"}
    return exercise.read_machine_times(spark, path).groupBy("job").agg(
        *[F.max(F.when(F.col("machine") == m, F.col("time"))).alias(n) for m, n in named.items()]
    )


@query(
    "calendar",
    printed(
        """SELECT CAST(i AS INTEGER) AS day_index, first + CAST(i AS INTEGER) AS calendar_date FROM
        (SELECT min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders),
        LATERAL (SELECT unnest(range(last - first + 1)) AS i)""",
        dates="calendar_date",
    ),
)
def calendar(spark, folder):
    day = F.to_date("o_orderdate")
    bounds = spark.read.parquet(f"{folder}/orders.parquet").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return exercise.calendar_days(bounds)


# ---- profiling and cleaning ----------------------------------------------------------------------

_FEED = (
    "station_name", "xml_station_name", "eva", "train_number", "line_number", "final_destination_station", "delay_in_min", "time",
    "is_canceled", "train_type", "train_line_ride_id", "train_line_station_num", "arrival_planned_time", "arrival_change_time",
    "departure_planned_time", "departure_change_time", "id", "source_file", "loaded_at_utc",
)


@query(
    "null_profile",
    with_ctes(
        stops_cte(),
        FULL_BRONZE,
        final=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM bronze" for c in _FEED
        ),
    ),
)
def null_profile(spark, folder):
    return explore.null_profile(feed(spark, folder))


_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)


def _described(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS deviation,
    CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest,
    quantile_cont(CAST({c} AS DOUBLE), 0.25) AS lower_quartile, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS upper_quartile FROM lineitem"""


@query(
    "describe_numbers",
    printed(
        " UNION ALL ".join(_described(c) for c in _NUMBERS),
        doubles="mean deviation lowest highest lower_quartile median upper_quartile",
        digits=4,
    ),
)
def describe_numbers(spark, folder):
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    described = explore.describe_numbers(items)
    doubles = ["mean", "deviation", "lowest", "highest", "lower_quartile", "median", "upper_quartile"]
    return described.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in doubles})


@query("shape", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def shape(spark, folder):
    return explore.shape(spark.read.parquet(f"{folder}/lineitem.parquet"))


_MESSY = """messy AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'xx' ELSE CAST(value AS VARCHAR) END AS height,
         CASE WHEN event_id % 40 = 0 THEN -60 ELSE user_id END AS weight,
         CAST(user_id AS VARCHAR) || CASE WHEN event_id % 9 = 0 THEN '' ELSE '_' || event_type END AS age_sex
  FROM events),
numbers AS (SELECT event_id, TRY_CAST(height AS DOUBLE) AS height,
                   CASE WHEN weight = -60 THEN 60 ELSE weight END AS weight,
                   TRY_CAST(split_part(age_sex, '_', 1) AS DOUBLE) AS age,
                   CASE WHEN contains(age_sex, '_') THEN split_part(age_sex, '_', 2) END AS sex FROM messy)"""


def _messy(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    key = F.col("event_id")
    suffix = F.when(key % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), "event_type"))
    return events.select(
        "event_id",
        F.when(key % 50 == 0, "xx").otherwise(F.col("value").cast("string")).alias("height"),
        F.when(key % 40 == 0, -60).otherwise(F.col("user_id")).alias("weight"),
        F.concat(F.col("user_id").cast("string"), suffix).alias("age_sex"),
        F.lit("unused").alias("section"),
    )


def _cleaned(spark, folder):
    rows = explore.numbers_or_null(_messy(spark, folder).drop("section"), "height")
    rows = explore.split_column(rows, "age_sex", "_", ["age", "sex"])
    rows = explore.numbers_or_null(rows, "age")
    return explore.replace_value(rows, "weight", -60, 60)


@query("cleaned_numbers", with_ctes(_MESSY, final=printed("SELECT * FROM numbers", doubles="height age")))
def cleaned_numbers(spark, folder):
    return _cleaned(spark, folder)


@query(
    "mean_fill",
    with_ctes(
        _MESSY,
        final=printed(
            "SELECT event_id, coalesce(height, (SELECT avg(height) FROM numbers)) AS height FROM numbers",
            doubles="height",
        ),
    ),
)
def mean_fill(spark, folder):
    return explore.fill_with_mean(_cleaned(spark, folder).select("event_id", "height"), "height")


@query(
    "head_and_tail",
    """SELECT * FROM (SELECT 'head' AS part, o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'tail', o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey DESC LIMIT 5)""",
)
def head_and_tail(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderpriority")
    first = explore.head(orders, ["o_orderkey"]).withColumn("part", F.lit("head"))
    return first.unionByName(explore.tail(orders, ["o_orderkey"]).withColumn("part", F.lit("tail")))
