"""Operator 12: shards of near equal bytes by a k-d tree over metadata. DataFrame functions only.

The points are distinct texts with the bytes of all their copies. A node that is to give k shards is split along its widest
dimension where the bytes reach the share of k // 2 of them. This weighted median is found for all nodes of a level at once, by histograms
that narrow its place 16 bits at a time; each is an aggregate over the points where they lie, so nothing is sorted or shuffled but sums.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.operators.ranking import rank_rows
from delaymill.session import spool

SHARDS = 24
ROW_BYTES = 8  # of a row besides its text
WHOLE = 64  # copies of a text are never parted while they fill at most this part of a shard
HALF = 31  # a coordinate has the scaled value in its upper bits, a hash of the point in as many lower ones
STEP = 16  # bits of a histogram
BROADCAST_ROWS = 100_000


def code(name: str) -> Column:
    """A place for a name: any order of names will do, equal ones must share it."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), 64 - HALF).cast("double")


def default_dimensions() -> dict[str, Column]:
    return {"lang": code("lang"), "source": code("source"), "bytes": F.log2("size"), "doc_id": F.col("doc_id").cast("double")}


def points(docs: DataFrame, shards: int | None, target_bytes: int | None, dimensions: Mapping[str, Column]) -> tuple[DataFrame, DataFrame, int]:
    """The rows (doc_id, size, text_crc32, key, part), the points (key, part, weight, one coordinate per dimension) and the shards.

    A point is a text with all its copies, placed at the least value that they have in each dimension. Of a text that fills more than
    1 / ``WHOLE`` of a shard, of which there are few, runs of copies by ascending id become points of their own. These follow each other in
    every dimension, so that a cut can run through one text only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("size", F.octet_length(text).cast("long") + ROW_BYTES)
    rows = rows.select(
        "doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(dimensions.values())],
    )
    rows = spool(rows, "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    values = [f"_v{i}" for i in range(len(dimensions))]
    summed = [F.sum("size").alias("weight"), *[F.min(v).alias(v) for v in values]]
    groups = spool(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *summed), "groups")
    least = max(1, total // (shards * WHOLE))
    most_parts = total // least + 1
    large = groups.filter(F.col("weight") > least).select("key", "n", F.expr(f"(weight + {least - 1}) div {least}").alias("parts"), *values)
    large = spool(large, "large")
    # each of them holds a part of the total, so they are fewer than most_parts; with very many shards the planner goes by the stored size
    near = F.broadcast if most_parts <= BROADCAST_ROWS else lambda df: df
    bounded = near(large.select("key", "n", "parts"))
    cut = rank_rows(rows.join(bounded, "key"), ["key"], [F.col("doc_id").asc_nulls_first()], "at")
    cut = spool(cut.withColumn("part", F.expr("(at - 1) * parts div n")).select(*rows.columns, "part"), "parts")
    light = rows.join(bounded, "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    whole = groups.join(bounded, "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    pieces = cut.groupBy("key", "part").agg(F.sum("size").alias("weight")).join(near(large.select("key", *values)), "key")
    found = whole.select("key", "part", "weight", *values).unionByName(pieces.select("key", "part", "weight", *values))
    part_bits = min(HALF - 1, most_parts.bit_length())
    bounds = F.broadcast(found.agg(*[f(v).alias(f"{n}{v}") for v in values for n, f in (("least", F.min), ("most", F.max))]))  # one row

    def coordinate(v: str) -> Column:
        low, high = F.col(f"least{v}"), F.col(f"most{v}")
        scaled = F.floor((F.col(v) - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(float(2**HALF))).cast("long")
        scaled = F.least(F.coalesce(scaled, F.lit(0)), F.lit(2**HALF - 1)).cast("long")
        tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("key"), 64 - HALF + part_bits), part_bits).bitwiseOR(F.col("part"))
        return F.shiftleft(scaled, HALF).bitwiseOR(tie)

    found = found.join(bounds).select("key", "part", "weight", *[coordinate(v).alias(f"c{i}") for i, v in enumerate(values)])
    return light.unionByName(cut).select("doc_id", "size", "text_crc32", "key", "part"), found, shards


def _medians(open_points: DataFrame, goals: DataFrame) -> DataFrame:
    """first, limit, of each node: the largest coordinate that goes to its left side.

    ``open_points`` has first (its node), c and weight; ``goals`` first, goal (bytes of the left side) and all (bytes of the node).
    """
    state = goals.select("first", "goal", "all", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    top = 2 * HALF
    by_bin = Window.partitionBy("first").orderBy("bin")  # at most 2 ** STEP rows of a node
    while True:
        shift = max(0, top - STEP)
        inside = open_points.join(F.broadcast(state), "first").filter(F.shiftright("c", top) == F.shiftright("low", top))
        bins = inside.groupBy("first", "goal", "all", "before", F.shiftright("c", shift).alias("bin"))
        bins = bins.agg(F.sum("weight").alias("held"), F.count(F.lit(1)).alias("n"))
        reached = F.col("before") + F.sum("held").over(by_bin)
        crossing = bins.withColumn("reached", reached).filter("reached >= goal AND reached - held < goal")
        state = crossing.select(
            "first", "goal", "all", F.shiftleft("bin", shift).alias("low"), (F.col("reached") - F.col("held")).alias("before"), "held", "n"
        )
        state = spool(state, "medians")  # one row a node
        top = shift
        if top == 0 or (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        state = state.drop("held", "n")
    nearer = (2 * F.col("before") + F.col("held") <= 2 * F.col("goal")) & (F.col("before") + F.col("held") < F.col("all"))
    last = F.col("low") + F.when((F.col("before") == 0) | nearer, F.lit(2**top - 1)).otherwise(F.lit(-1))
    return state.select("first", last.alias("limit"))


def _split(placed: DataFrame, dimensions: int) -> DataFrame:
    """``placed`` with every node of more than one shard (first, k) split into two."""
    wide = placed.filter("k > 1")
    spread = [F.max(F.shiftright(f"c{i}", HALF)) - F.min(F.shiftright(f"c{i}", HALF)) for i in range(dimensions)]
    nodes = wide.groupBy("first", "k").agg(F.sum("weight").alias("all"), F.array(*spread).alias("spread"))
    widest = (F.array_position("spread", F.array_max("spread")) - 1).cast("int")
    left = F.expr("k div 2")
    goal = F.greatest(F.lit(1), F.floor(F.col("all") * (left / F.col("k"))).cast("long"))
    nodes = spool(nodes.select("first", widest.alias("dimension"), "all", goal.alias("goal"), left.alias("left")), "nodes")
    along = reduce(lambda held, i: F.when(F.col("dimension") == i, F.col(f"c{i}")).otherwise(held), range(1, dimensions), F.col("c0"))
    moving = wide.join(F.broadcast(nodes.select("first", "dimension")), "first").select("first", along.alias("c"), "weight")
    splits = nodes.select("first", "dimension", "left").join(_medians(moving, nodes), "first")
    met = placed.join(F.broadcast(splits), "first", "left")  # at most one row a shard
    right, cut = along > F.col("limit"), F.col("limit").isNotNull()
    return met.select(
        *[c for c in placed.columns if c not in ("first", "k")],
        F.when(cut & right, F.col("first") + F.col("left")).otherwise(F.col("first")).alias("first"),
        F.when(~cut, F.col("k")).when(right, F.col("k") - F.col("left")).otherwise(F.col("left")).alias("k"),
    )


def assign(
    docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: Mapping[str, Column] | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard, ascending doc_id) of every row of ``docs``.

    With ``shards`` None there are as many as it takes to hold ``target_bytes`` each. ``dimensions`` are numbers computed from a row's
    columns and ``size``; by default language, source, bytes and doc_id. Sizes differ by little more than single rows. Equal texts share
    a shard, but for those that a cut runs through, at most one for each cut, of which the copies fill more than 1 / ``WHOLE`` of a shard. Null texts count as empty ones and null names as '', a null number lies at the low end;
    repeated rows are copies; a shard is empty only where there are fewer points than shards; other columns are not looked at.
    """
    dimensions = default_dimensions() if dimensions is None else dimensions
    rows, found, shards = points(docs, shards, target_bytes, dimensions)
    placed = spool(found.select("*", F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("k")), "placed")
    for _ in range((shards - 1).bit_length()):
        placed = spool(_split(placed, len(dimensions)), "placed")
    at = placed.select("key", "part", F.col("first").cast("int").alias("shard"))
    dealt = rows.join(at, ["key", "part"]).select("doc_id", "size", "text_crc32", "shard")
    numbered = rank_rows(dealt, ["shard"], [F.col("doc_id").asc_nulls_first()], "slot")
    return numbered.withColumn("slot", F.col("slot") - 1)
