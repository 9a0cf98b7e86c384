"""Versions of layer tables, ordered files, reports and pruned reads."""

import pytest
from pyspark.sql import functions as F

from delaymill.operators import layer_checks, quality, scope
from delaymill.sources import layers
from registry.layers import moved_months


def frame(spark, start, n):
    return spark.range(start, start + n).select("id", (F.col("id") % 3).alias("part"), F.concat(F.lit("v"), "id").alias("text"))


def dated(rows):
    return quality.row_rules(rows, {"ids are known": F.col("id").isNull()})


@pytest.mark.parametrize("by", [None, "part"])
def test_a_failed_replacement_leaves_the_table_as_it_was(spark, tmp_path, by):
    name = f"kept_{by}"

    def save(df):
        return layers.save_layer_table(df, str(tmp_path), "versions_test", name, by, ("id",), dated)

    spark.sql(f"DROP TABLE IF EXISTS versions_test.{name}") if spark.catalog.databaseExists("versions_test") else None
    assert save(frame(spark, 0, 30)).count() == 30
    old = spark.table(f"versions_test.{name}")
    assert {r.id for r in save(frame(spark, 100, 20)).collect()} == set(range(100, 120))
    assert old.filter("id < 50").count() in (0, 30)  # a reader that began before still finds its files
    with pytest.raises(ValueError, match="ids are known"):
        save(frame(spark, 200, 10).withColumn("id", F.when(F.col("id") != 205, F.col("id"))))
    assert {r.id for r in spark.table(f"versions_test.{name}").collect()} == set(range(100, 120))
    broken = frame(spark, 300, 10).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        save(broken)
    assert {r.id for r in spark.table(f"versions_test.{name}").collect()} == set(range(100, 120))
    wider = save(frame(spark, 400, 5).withColumn("more", F.lit(1)))
    assert wider.columns[-1] == "more" and spark.table(f"versions_test.{name}").count() == 5


def scanned(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_a_narrow_range_of_ordered_files_is_scanned_alone(spark, tmp_path):
    rows = spark.range(200_000).select((F.xxhash64("id") % 1000).alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = layers.save_frame(rows.repartition(8), f"{tmp_path}/plain")
        ordered = layers.save_frame(rows, f"{tmp_path}/ordered", order=("key",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    narrow = "key BETWEEN 500 AND 510"
    assert sorted(ordered.filter(narrow).collect()) == sorted(plain.filter(narrow).collect())
    assert scanned(ordered.filter(narrow)) < scanned(plain.filter(narrow)) / 2
    files = ordered.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:]))


def test_reports_hold_parts_of_any_length(spark, tmp_path):
    path = f"{tmp_path}/report"
    layers.write_report(spark, {"name": "ä", "n": 3}, {"long": spark.range(5000), "none": spark.range(0)}, path)
    layers.write_report(spark, {"name": "b", "n": 4}, {"long": spark.range(7000).repartition(3)}, path)
    assert layers.read_facts(spark, path) == {"name": "b", "n": 4}
    assert layers.read_part(spark, path, "long").agg(F.sum("id")).first()[0] == sum(range(7000))
    assert layers.read_part(spark, path, "none", "id long").count() == 0


def test_week_search_opens_the_nearest_files_and_pushes_its_filters(spark):
    paths = moved_months(spark, "/root/testdata/sf0.001")
    weeks = scope.search_weeks(spark, paths, "data-2024-01.parquet", "Station 7")
    assert {r.source_file for r in weeks.collect()} <= {f"data-{m}.parquet" for m in ("2023-11", "2023-12", "2024-02", "2024-03")}
    plan = spark._jvm.PythonSQLUtils.explainString(weeks._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and all("EqualTo(station_name,Station 7)" in p and "GreaterThanOrEqual(time," in p and "LessThan(time," in p for p in pushed)
    assert "2023-06" not in plan and "data-2024-01" not in plan
    with pytest.raises(ValueError, match="no month file"):
        scope.search_weeks(spark, paths[2:3], "data-2024-01.parquet", "Station 7")


def test_layers_are_read_once_by_their_checks(spark, tmp_path):
    from registry.common import feed
    from registry.layers import layer_frames
    from delaymill.operators import features

    bronze = layers.save_frame(feed(spark, "/root/testdata/sf0.001"), f"{tmp_path}/bronze")
    stations, _, fact, gold = (layers.save_frame(t, f"{tmp_path}/{i}") for i, t in enumerate(layer_frames(bronze)))
    hours = layers.save_frame(features.station_hour(gold), f"{tmp_path}/hours")
    manifest = bronze.groupBy("eva").agg(F.count(F.lit(1)).alias("row_count"))
    found = layer_checks.layer_violations(bronze, manifest, fact, stations, gold, hours, "Station 7")
    assert {r.violations for r in found.collect()} == {0}
    scans = found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
    assert scans.count("parquet") == 6  # bronze twice, as the manifest here is made from it
