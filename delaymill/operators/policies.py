"""Capacity-limited selection of events per horizon under several policies.

All policies look at the same bounded pool of the best candidates of a horizon. With at most ``k``
rows to choose, one per journey, a row can be left out of the pool without changing any choice when
one of these holds (better means more likely, or equal and smaller key):

1. the same journey has a better row at the same station,
2. ``k`` other journeys have a better row at the same station,
3. the same journey has better rows at ``k`` other stations,
4. ``2k(k-1)+1`` rows that survive 1-3 are better. As each station and journey covers at most ``k`` of
   them, 2k-1 of them share neither station nor journey, and a choice blocks at most 2k-2 of those.

In each case a free, better row at no higher penalty exists, so replacing never hurts. Every rule is
a top-k per group, which is applied on the map side before rows are shuffled; no task sees more than
the pool of one horizon, whatever its size.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.config import DIRECT, GREEDY, RANDOM, SCORE_FIRST, SOLVED, STOPPED, Policy
from delaymill.operators import assignment
from delaymill.operators.assignment import SCALE, proved_picks
from delaymill.operators.candidates import HORIZON, OUTCOME, PROBABILITY

# the helper travels with the function, so that workers need no installed copy of this package
cloudpickle.register_pickle_by_value(assignment)


PICK_FIELDS = ("rank_value", "stop_event_key", "journey_id", "station_id", "p", "severe")


def _pick_fields() -> list[Column]:
    return [
        (-F.col(PROBABILITY)).alias("rank_value"),
        "stop_event_key",
        "journey_id",
        "station_id",
        F.col(PROBABILITY).alias("p"),
        F.coalesce(F.col(OUTCOME), F.lit(False)).alias("severe"),
    ]


def _first(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    window = Window.partitionBy(*group).orderBy("rank_value", "stop_event_key")
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def pool_steps(candidates: DataFrame, most: int) -> list[DataFrame]:
    """The eligible rows, and what each of the four rules leaves of them."""
    steps = [candidates.filter("is_eligible_candidate").select(*HORIZON, *_pick_fields())]
    rules = [
        ([*HORIZON, "journey_id", "station_id"], 1),
        ([*HORIZON, "station_id"], most),
        ([*HORIZON, "journey_id"], most),
        (HORIZON, 2 * most * (most - 1) + 1),
    ]
    for group, n in rules:
        steps.append(_first(steps[-1], group, n))
    return steps


def review_pool(candidates: DataFrame, most: int) -> DataFrame:
    """One row per horizon with its pool in priority order, enough for any choice of up to ``most`` rows."""
    rows = pool_steps(candidates, most)[-1]
    fields = [c for c in rows.columns if c not in HORIZON]
    return rows.groupBy(*HORIZON).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pool"))


def random_order(seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "horizon_id", "stop_event_key"), 256)


def random_pool(candidates: DataFrame, seed: int, most: int) -> DataFrame:
    """The first ``most`` journeys of each horizon in a seeded order that no row order can change."""
    rows = candidates.filter("is_eligible_candidate").select(*HORIZON, random_order(seed).alias("draw"), *_pick_fields())
    first = Window.partitionBy(*HORIZON, "journey_id").orderBy("draw", "stop_event_key")
    per_journey = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    window = Window.partitionBy(*HORIZON).orderBy("draw", "stop_event_key")
    drawn = per_journey.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= most)
    row = F.struct("draw", *[F.col(f) for f in PICK_FIELDS])
    return drawn.groupBy(*HORIZON).agg(F.array_sort(F.collect_list(row)).alias("drawn"))


def _numbers(pool: Column) -> Column:
    return F.sequence(F.lit(0), F.size(pool) - 1)


def score_first_picks(pool: Column, most: int) -> Column:
    """Positions of the first row of each journey, best journeys first."""
    journeys = pool.getField("journey_id")
    firsts = F.filter(_numbers(pool), lambda i: F.array_position(journeys, F.get(journeys, i)) == i + 1)
    return F.slice(firsts, 1, most)


def greedy_picks(pool: Column, most: int, preferred: int, penalty: float) -> Column:
    """Positions in the order a greedy choice with a station penalty takes them."""

    def step(state: Column, _: Column) -> Column:
        def value(row: Column, i: Column) -> Column:
            there = F.size(F.filter(state.getField("stations"), lambda s: s == row.getField("station_id")))
            fine = F.when(there >= preferred, F.lit(float(penalty))).otherwise(F.lit(0.0))
            free = ~F.array_contains(state.getField("journeys"), row.getField("journey_id"))
            return F.when(free, F.struct((row.getField("p") - fine).alias("value"), (-i).alias("order")))

        def take(best: Column) -> Column:
            i = -best.getField("order")
            row = F.get(pool, i)
            grown = F.struct(
                F.array_append(state.getField("picks"), i).alias("picks"),
                F.array_append(state.getField("journeys"), row.getField("journey_id")).alias("journeys"),
                F.array_append(state.getField("stations"), row.getField("station_id")).alias("stations"),
            )
            return F.when(best.isNull(), state).otherwise(grown)

        # the one-element array binds the best row, so that it is searched once per step
        return F.get(F.transform(F.array(F.array_max(F.transform(pool, value))), take), 0)

    start = F.struct(
        F.array().cast("array<int>").alias("picks"),
        F.array().cast("array<string>").alias("journeys"),
        F.array().cast("array<string>").alias("stations"),
    )
    rounds = F.sequence(F.lit(1), F.lit(most))
    return F.aggregate(rounds, start, step, lambda state: state.getField("picks"))


def exact_picks(grid: list[tuple[int, float]], capacities: tuple[int, ...], steps: int | None = None):
    """A function of (probabilities, journeys, stations) arrays: the optimal positions for every
    (load, penalty) of the grid and every capacity, with the dual values that prove them."""
    kind = "array<struct<load:int,penalty:double,capacity:int,picks:array<int>,place:bigint,prices:array<bigint>>>"

    @F.pandas_udf(kind)
    def solve(probabilities: pd.Series, journeys: pd.Series, stations: pd.Series) -> pd.Series:
        answers = []
        for p, j, s in zip(probabilities, journeys, stations):
            answer = []
            for load, penalty in grid:
                found = proved_picks(p, list(j), list(s), load, penalty, capacities, steps)
                answer += [
                    {"load": load, "penalty": penalty, "capacity": c, "picks": picks, "place": place, "prices": prices}
                    for c, (picks, place, prices) in zip(capacities, found)
                ]
            answers.append(answer)
        return pd.Series(answers)

    return solve


def _solved(pool: Column, grid: list[tuple[int, float]], capacities: tuple[int, ...], steps: int | None) -> Column:
    return exact_picks(grid, capacities, steps)(*[pool.getField(f) for f in ("p", "journey_id", "station_id")])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _with(value: Column, build) -> Column:
    """``build`` of a value that is used several times and computed once: it is the one element of an array."""
    return F.get(F.transform(F.array(value), build), 0)


def certified_status(pool: Column, answer: Column) -> Column:
    """OPTIMAL if the dual values of an answer prove its objective, else the status of a search that was stopped.

    Any price of a place and prices of stations from 0 to the penalty bound every choice of that size from above: by the places, the
    preferred loads at their stations' prices, and for each journey the most that a row of it is worth beyond place and station. Whole numbers make
    the comparison exact; nothing is taken on trust from the search.
    """
    scaled = lambda x: F.rint(x * F.lit(float(SCALE))).cast("long")
    fine, load, place = scaled(answer["penalty"]), answer["load"], answer["place"]
    rows = F.transform(pool, lambda x, i: F.struct(
        x["journey_id"].alias("j"), x["station_id"].alias("s"), scaled(x["p"]).alias("w"), F.get(answer["prices"], i).alias("v")
    ))

    def most(gains: Column) -> Column:
        own = lambda j: F.transform(F.filter(gains, lambda x: x["j"] == j), lambda x: x["g"])
        return _total(F.transform(F.array_distinct(gains["j"]), lambda j: F.array_max(own(j))))

    def bound(rows: Column) -> Column:
        priced = F.array_distinct(F.transform(rows, lambda x: F.struct(x["s"].alias("s"), x["v"].alias("v"))))
        gains = F.transform(rows, lambda x: F.struct(x["j"].alias("j"), (x["w"] - place - x["v"]).alias("g")))
        gains = _with(F.filter(gains, lambda x: x["g"] > 0), most)
        total = F.size(answer["picks"]) * place + load * _total(F.transform(priced, lambda x: x["v"])) + gains
        sound = (F.size(priced) == F.size(F.array_distinct(rows["s"]))) & F.forall(priced, lambda x: (x["v"] >= 0) & (x["v"] <= fine))
        return F.when(sound, total)

    def objective(picked: Column) -> Column:
        loads = F.transform(F.array_distinct(picked["s"]), lambda s: F.size(F.filter(picked["s"], lambda other: other == s)))
        excess = _total(F.transform(loads, lambda n: F.greatest(n - load, F.lit(0)).cast("long")))
        single = F.size(F.array_distinct(picked["j"])) == F.size(picked)
        return F.when(single, _total(F.transform(picked, lambda x: x["w"])) - fine * excess)

    def met(rows: Column) -> Column:
        return _with(F.transform(answer["picks"], lambda i: F.get(rows, i)), objective) == _with(rows, bound)

    return F.when(F.coalesce(_with(rows, met), F.lit(False)), SOLVED).otherwise(STOPPED)


def _rows_at(pool: Column, positions: Column) -> Column:
    return F.transform(F.array_sort(positions), lambda i: F.get(pool, i))


def choices(
    candidates: DataFrame,
    policy: Policy,
    capacities: tuple[int, ...] | None = None,
    names: tuple[str, ...] | None = None,
) -> DataFrame:
    """Chosen rows, in priority order, per horizon, policy and capacity.

    Score-first, greedy and random choices of a small capacity are the beginning of those of a larger
    one; the exact choice is computed for each capacity. Only the policies of ``names`` (all by default) are planned.
    """
    search = policy.search
    exact = search.optimization_policy_name
    capacities = tuple(capacities or search.scenario_capacities)
    wanted = set(names or (SCORE_FIRST, GREEDY, exact, RANDOM))
    unknown = wanted - {SCORE_FIRST, GREEDY, exact, RANDOM}
    if unknown:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    parts = []
    if wanted - {RANDOM}:
        parts.append(_pool_choices(candidates, policy, capacities, wanted))
    if RANDOM in wanted:
        drawn = random_pool(candidates, search.random_seed, max(capacities))
        plain = F.transform("drawn", lambda x: F.struct(*[x.getField(f).alias(f) for f in PICK_FIELDS]))
        draws = [_option(RANDOM, c, F.array_sort(F.slice(plain, 1, c)), F.lit(DIRECT)) for c in capacities]
        parts.append(drawn.select(*HORIZON, F.inline(F.array(*draws))))
    return reduce(DataFrame.unionByName, parts)


def _pool_choices(candidates: DataFrame, policy: Policy, capacities: tuple[int, ...], wanted: set[str]) -> DataFrame:
    """The choices of the wanted policies that look at the review pool."""
    most, pool = max(capacities), F.col("pool")
    load, penalty = policy.preferred_station_load, policy.station_penalty
    exact = policy.search.optimization_policy_name
    columns = {
        SCORE_FIRST: lambda: score_first_picks(pool, most),
        GREEDY: lambda: greedy_picks(pool, most, load, penalty),
        exact: lambda: _solved(pool, [(load, penalty)], capacities, policy.search.solver_step_limit),
    }
    columns = {name: build() for name, build in columns.items() if name in wanted}
    planned = review_pool(candidates, most).withColumns({f"_{name}": c for name, c in columns.items()})
    options = []
    for at, c in enumerate(capacities):
        for name in columns:
            own = F.col(f"`_{name}`")
            if name == exact:
                answer = F.get(own, F.lit(at))
                options.append(_option(name, c, _rows_at(pool, answer["picks"]), certified_status(pool, answer)))
            else:
                options.append(_option(name, c, _rows_at(pool, F.slice(own, 1, c)), F.lit(DIRECT)))
    return planned.select(*HORIZON, F.inline(F.array(*options)))


def _option(name: str, capacity: int, rows: Column, status: Column) -> Column:
    return F.struct(
        F.lit(name).alias("policy_name"), F.lit(capacity).alias("capacity_per_hour"), rows.alias("picks"), status.alias("solver_status")
    )


def search_choices(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Exact choices at the tuning capacity for every searched load and penalty."""
    search = policy.search
    capacity = search.canonical_tuning_capacity_per_hour
    grid = [
        (load, penalty)
        for load in search.preferred_station_load_per_station_hour_candidates
        for penalty in search.penalties
    ]
    pool = F.col("pool")
    solved = review_pool(candidates, capacity).withColumn("solved", _solved(pool, grid, (capacity,), search.solver_step_limit))
    return solved.select(*HORIZON, "pool", F.explode("solved").alias("answer")).select(*HORIZON, "pool", "answer", "answer.*").select(
        *HORIZON,
        F.col("load").alias("preferred_station_load_per_station_hour"),
        F.col("penalty").alias("station_excess_penalty_lambda"),
        _rows_at(pool, F.col("picks")).alias("picks"),
        certified_status(pool, F.col("answer")).alias("solver_status"),
    )


def selections(chosen: DataFrame) -> DataFrame:
    """One row per chosen event with its rank in the choice."""
    keys = [c for c in chosen.columns if c not in ("picks", "solver_status")]
    return chosen.select(*keys, F.posexplode("picks").alias("at", "pick")).select(
        *keys,
        (F.col("at") + 1).alias("selection_rank"),
        "pick.stop_event_key",
        "pick.journey_id",
        "pick.station_id",
        F.col("pick.p").alias(PROBABILITY),
        F.col("pick.severe").alias(OUTCOME),
    )
