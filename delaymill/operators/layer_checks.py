"""Checks that rows carry through bronze, silver and gold, from one pass over each layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.operators import features


def _counts(bronze: DataFrame, manifest: DataFrame, fact: DataFrame, stations: DataFrame, gold: DataFrame, hours: DataFrame, hub: str) -> DataFrame:
    """One row with what the rules compare; every layer is aggregated once."""
    n = F.count(F.lit(1))
    recomputed = features.station_hour(gold)
    keys = features.STATION_HOUR_KEYS
    compared = [c for c in recomputed.columns if c not in keys]
    stored = hours.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *compared)])
    same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    there, stored_there = F.col("stop_event_count").isNotNull(), F.col("_stop_event_count").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compared])
    both = recomputed.join(stored, same_key, "full").agg(
        F.sum("stop_event_count").alias("gold_rows"),
        F.count_if(there).alias("gold_keys"),
        F.count_if(stored_there).alias("hour_rows"),
        F.sum("_stop_event_count").alias("hour_events"),
        F.count_if(differs).alias("hour_mismatches"),
    )
    parts = [
        bronze.agg(n.alias("bronze_rows"), F.count_if(F.col("station_name") == hub).alias("hub_rows"), F.count_distinct("eva").alias("bronze_stations")),
        manifest.agg(F.sum("row_count").alias("manifest_rows")),
        fact.agg(n.alias("fact_rows")),
        stations.agg(n.alias("station_rows")),
        both,
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of one row each


def layer_violations(
    bronze: DataFrame, manifest: DataFrame, fact: DataFrame, stations: DataFrame, gold: DataFrame, hours: DataFrame, hub: str
) -> DataFrame:
    """(rule, violations): by how many rows a layer departs from the one before, and stored aggregates from a recomputation."""

    def apart(left: str, right: str) -> Column:
        return F.abs(F.coalesce(left, F.lit(0)) - F.coalesce(right, F.lit(0))).cast("long")

    rules = {
        "bronze holds rows": (F.col("bronze_rows") == 0).cast("long"),
        "bronze holds the hub": (F.col("hub_rows") == 0).cast("long"),
        "manifest counts every bronze row": apart("manifest_rows", "bronze_rows"),
        "silver keeps every bronze row": apart("fact_rows", "bronze_rows"),
        "every station id has one row": apart("station_rows", "bronze_stations"),
        "gold keeps every silver row": apart("gold_rows", "fact_rows"),
        "one row per station and hour": apart("hour_rows", "gold_keys"),
        "station hours count every row": apart("hour_events", "gold_rows"),
        "station hours match their events": F.coalesce("hour_mismatches", F.lit(0)).cast("long"),
    }
    counts = _counts(bronze, manifest, fact, stations, gold, hours, hub)
    checked = counts.select(*[violations.alias(rule) for rule, violations in rules.items()])
    return checked.unpivot([], [F.col(f"`{rule}`") for rule in rules], "rule", "violations")
