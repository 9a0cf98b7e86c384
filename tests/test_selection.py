"""Candidates and policies on literal rows."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from delaymill.config import EXACT, GREEDY, RANDOM, SCORE_FIRST, Policy, SearchConfig
from delaymill.operators import candidates as cand
from delaymill.operators import outcomes as out
from delaymill.operators import policies as pol

DAY = date(2025, 3, 19)
COLUMNS = (
    "stop_event_key string, journey_id string, service_date date, hour_of_day int, station_id string, "
    "prediction_split string, predicted_probability double, actual_is_departure_severe_delay boolean"
)
ROWS = [
    ("A1", "J1", DAY, 8, "S1", "validation", 0.95, True),
    ("A2", "J1", DAY, 8, "S1", "validation", 0.90, False),
    ("A3", "J2", DAY, 8, "S2", "validation", 0.89, True),
    ("B1", "J3", DAY, 8, "S1", "validation", 0.88, True),
    ("B2", "J4", DAY, 8, "S3", "validation", 0.72, False),
    ("C1", "J5", DAY, 9, "S4", "validation", 0.60, False),
    ("D1", "J6", DAY, 10, "S5", "test", 0.91, True),
]
POLICY = Policy(
    selected_threshold=0.4,
    scoring_model_name="logistic_regression",
    scoring_model_version="v1",
    preferred_station_load=1,
    station_penalty=0.2,
)


def scored(spark, rows=ROWS):
    return spark.createDataFrame(rows, COLUMNS).withColumns({
        "train_type": F.lit("ICE"),
        "line_number": F.lit("1"),
        "model_name": F.lit("logistic_regression"),
        "model_version": F.lit("v1"),
        "selected_threshold": F.lit(0.4),
    })


def outcomes(candidates, policy=POLICY):
    return out.horizon_outcomes(cand.horizon_candidates(candidates), pol.choices(candidates, policy), policy)


@pytest.fixture(scope="module")
def results(spark):
    rows = outcomes(cand.prepare_candidates(scored(spark), POLICY)).collect()
    return {(r.horizon_id, r.policy_name, r.capacity_per_hour): r for r in rows}


def test_search_settings():
    search = SearchConfig()
    assert search.scenario_capacities == (1, 3, 5, 10)
    assert search.penalties == (0.0, 0.05, 0.1, 0.2)
    assert search.random_seed == 17


def test_freeze_checks():
    POLICY.check_frozen()
    for bad in (
        {"station_penalty": 0.0},
        {"station_penalty": 0.3},
        {"minimum_candidate_probability": 0.5},
        {"preferred_station_load": 0},
    ):
        with pytest.raises(ValueError):
            replace(POLICY, **bad).check_frozen()


def test_targets_and_choices(results):
    morning = f"{DAY}|8"
    assert results[morning, EXACT, 3].feasible_selection_target == 3
    assert results[morning, EXACT, 10].feasible_selection_target == 4
    assert results[morning, SCORE_FIRST, 3].selected_keys == ["A1", "A3", "B1"]
    for policy in (EXACT, GREEDY):
        assert results[morning, policy, 3].selected_keys == ["A1", "A3", "B2"]
    assert results[morning, EXACT, 1].selected_keys == results[morning, SCORE_FIRST, 1].selected_keys == ["A1"]
    assert results[f"{DAY}|10", EXACT, 3].execution_mode == "final"


def test_penalty_and_ratios(results):
    row = results[f"{DAY}|8", SCORE_FIRST, 3]
    assert row.station_concentration_excess_total == 1.0 and row.penalty_active_in_horizon
    assert row.precision_at_capacity == 1.0
    assert row.severe_delay_coverage == 1.0
    assert row.candidate_prevalence == pytest.approx(3 / 5)


def test_undefined_ratios_are_null(spark):
    strict = replace(POLICY, selected_threshold=0.99)
    rows = outcomes(cand.prepare_candidates(scored(spark), strict), strict).filter(f"horizon_id = '{DAY}|9'").collect()
    assert len(rows) == 16
    for row in rows:
        assert row.eligible_candidate_count == 0 and row.selected_event_count == 0
        assert row.candidate_prevalence is None and row.precision_at_capacity is None
        assert row.severe_delay_coverage is None and row.lift_over_candidate_prevalence is None


def test_random_does_not_depend_on_row_order(spark):
    frame = scored(spark)
    first = pol.random_pool(cand.prepare_candidates(frame, POLICY), 17, 3).collect()
    second = pol.random_pool(cand.prepare_candidates(frame.orderBy(F.rand(7)).repartition(5), POLICY), 17, 3).collect()
    assert sorted(first) == sorted(second)


def test_reasons(spark):
    rows = [
        ("K1", "J1", DAY, 8, "S1", "validation", None, True),
        ("K2", "J1", DAY, 8, "S1", "validation", 1.5, True),
        ("K3", "J1", DAY, 8, "S1", "validation", 0.1, True),
        ("K4", None, DAY, 8, "S1", "validation", 0.9, True),
        ("K5", "J1", DAY, 8, "S1", "validation", 0.9, True),
        ("K6", "J1", DAY, 8, "S1", "validation", None, True),
        ("K6", "J1", DAY, 9, "S1", "validation", 0.9, True),
        ("K7", "J1", DAY, 8, "S1", "train", 0.9, True),
    ]
    found = cand.prepare_candidates(scored(spark, rows), POLICY).collect()
    reasons = sorted((r.stop_event_key, r.eligibility_reason) for r in found)
    assert reasons == [
        ("K1", cand.INVALID_PROBABILITY),
        ("K2", cand.INVALID_PROBABILITY),
        ("K3", cand.BELOW_THRESHOLD),
        ("K4", cand.MISSING_FIELD),
        ("K5", cand.ELIGIBLE),
        ("K6", cand.DUPLICATE_KEY),
        ("K6", cand.DUPLICATE_KEY),
    ]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="journey_id"):
        cand.prepare_candidates(scored(spark).drop("journey_id"), POLICY)
    with pytest.raises(ValueError, match="predicted_probability"):
        cand.prepare_candidates(scored(spark).drop("predicted_probability"), POLICY)


def test_decisions_have_ranks(spark):
    ranked = cand.rank_candidates(cand.prepare_candidates(scored(spark), POLICY))
    rows = out.event_decisions(ranked, outcomes(ranked), POLICY, EXACT, 3).collect()
    assert len(rows) == 7
    chosen = {r.stop_event_key: r for r in rows if r.selected_for_review}
    assert {k: r.selection_rank for k, r in chosen.items()} == {"A1": 1, "A3": 2, "B2": 3, "C1": 1, "D1": 1}
    assert chosen["B2"].objective_contribution == 0.72
    assert {r.stop_event_key: r.candidate_priority_rank for r in rows if r.hour_of_day == 8} == {
        "A1": 1,
        "A2": 2,
        "A3": 3,
        "B1": 4,
        "B2": 5,
    }
    development = [r.solver_objective_value for r in rows if r.execution_mode == "development"]
    assert development[0] == pytest.approx(2.56 + 0.60)


def test_comparison_and_diagnostics(spark):
    found = outcomes(cand.prepare_candidates(scored(spark), POLICY))
    comparison = out.policy_comparison(found).filter("execution_mode = 'development' AND capacity_per_hour = 3")
    rows = {r.policy_name: r for r in comparison.collect()}
    assert set(rows) == {RANDOM, SCORE_FIRST, GREEDY, EXACT}
    assert rows[SCORE_FIRST].expected_risk_score_captured == pytest.approx(0.95 + 0.89 + 0.88 + 0.60)
    assert rows[EXACT].median_feasible_selection_target == 2.0
    agreement = out.pairwise_diagnostics(found, SCORE_FIRST, EXACT, 3).filter("execution_mode = 'development'").first()
    assert agreement.matching_horizon_count + agreement.differing_horizon_count == agreement.horizon_count == 2
    assert agreement.selected_event_disagreement_count == 2
    assert agreement.mean_selected_set_jaccard == pytest.approx((0.5 + 1.0) / 2)


def test_dense_horizons_match_brute_force(spark):
    """Many candidates on few stations: greedy and exact choices against plain Python."""
    import random

    from delaymill.operators.assignment import optimal_picks

    draw = random.Random(3)
    rows = []
    for hour in range(6):
        for i in range(60):
            p = draw.choice([0.5, 0.6, 0.75, 0.9, 1.0])
            where = (f"J{draw.randint(0, 25)}", f"S{draw.randint(0, 3)}")
            rows.append((f"H{hour}-{i:02d}", where[0], DAY, hour, where[1], "validation", p, draw.random() < 0.5))
    candidates = cand.prepare_candidates(scored(spark, rows), POLICY).repartition(7)
    chosen = {(r.horizon_id, r.policy_name, r.capacity_per_hour): r for r in pol.choices(candidates, POLICY).collect()}
    for hour in range(6):
        pool = sorted((r for r in rows if r[3] == hour), key=lambda r: (-r[6], r[0]))
        seen, unique = set(), []
        for r in pool:
            if (r[1], r[4]) not in seen:
                seen.add((r[1], r[4]))
                unique.append(r)
        exact = optimal_picks(
            [r[6] for r in unique], [r[1] for r in unique], [r[4] for r in unique], 1, 0.2, (1, 3, 5, 10)
        )
        taken = []
        for _ in range(10):
            free = [r for r in pool if r[1] not in {t[1] for t in taken}]
            loads = [t[4] for t in taken]
            taken.append(max(free, key=lambda r: (r[6] - (0.2 if r[4] in loads else 0.0), r[6], -pool.index(r))))
        for at, capacity in enumerate((1, 3, 5, 10)):
            got = [p.stop_event_key for p in chosen[f"{DAY}|{hour}", EXACT, capacity].picks]
            assert got == [unique[i][0] for i in sorted(exact[at])]
            greedy = {p.stop_event_key for p in chosen[f"{DAY}|{hour}", GREEDY, capacity].picks}
            assert greedy == {t[0] for t in taken[:capacity]}


def test_only_wanted_policies_are_planned(spark):
    candidates = cand.prepare_candidates(scored(spark), POLICY)
    for name in (SCORE_FIRST, GREEDY, RANDOM, EXACT):
        chosen = pol.choices(candidates, POLICY, names=(name,))
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert ("ArrowEvalPython" in plan) == (name == EXACT)
        assert {r.policy_name for r in chosen.select("policy_name").distinct().collect()} == {name}
    with pytest.raises(ValueError, match="unknown"):
        pol.choices(candidates, POLICY, names=("other",))


def test_the_status_is_proved_by_the_prices_alone(spark):
    pool = [(-0.9, "A", "J1", "S1", 0.9, True), (-0.8, "B", "J2", "S1", 0.8, True), (-0.7, "C", "J3", "S2", 0.7, True)]
    price = 10**12 // 10
    answers = [
        ([0, 2], 7 * price, [2 * price, 2 * price, 0], "OPTIMAL"),
        ([2, 0], 7 * price, [price, price, 0], "OPTIMAL"),
        ([0, 1], 7 * price, [2 * price, 2 * price, 0], "TIME_LIMIT_WITH_INCUMBENT"),  # not the best choice
        ([0, 2], 6 * price, [price, price, 0], "TIME_LIMIT_WITH_INCUMBENT"),  # prices that prove nothing
        ([0, 2], 7 * price, [2 * price, price, 0], "TIME_LIMIT_WITH_INCUMBENT"),  # two prices of one station
        ([0, 2], 7 * price, [3 * price, 3 * price, 0], "TIME_LIMIT_WITH_INCUMBENT"),  # above the penalty
        ([0, 0], 7 * price, [2 * price, 2 * price, 0], "TIME_LIMIT_WITH_INCUMBENT"),  # one journey twice
        ([0, 2], None, None, "TIME_LIMIT_WITH_INCUMBENT"),
    ]
    kind = (
        "pool array<struct<rank_value:double,stop_event_key:string,journey_id:string,station_id:string,p:double,severe:boolean>>, "
        "answer struct<load:int,penalty:double,capacity:int,picks:array<int>,place:bigint,prices:array<bigint>>, want string"
    )
    frame = spark.createDataFrame([(pool, (1, 0.2, 2, picks, place, prices), want) for picks, place, prices, want in answers], kind)
    for r in frame.select(pol.certified_status(F.col("pool"), F.col("answer")).alias("got"), "want").collect():
        assert r.got == r.want


def test_a_full_pool_keeps_the_optimum(spark):
    """Crowded hours in which every rule of the pool leaves rows out: as good as the choice among all rows."""
    import random

    from delaymill.operators.assignment import optimal_picks

    draw = random.Random(8)
    rows = [
        (f"E{i:04d}", f"J{s}-{draw.randrange(14)}", DAY, 8, f"S{s}", "validation", round(0.4 + 0.6 * draw.random(), 4), False)
        for i in range(1200)
        for s in [draw.randrange(25)]
    ]
    rows += [(f"W{s:02d}", "J-everywhere", DAY, 8, f"S{s}", "validation", 0.99 + s / 10_000, False) for s in range(25)]
    candidates = cand.prepare_candidates(scored(spark, rows), POLICY)
    left = [step.count() for step in pol.pool_steps(candidates, 10)]
    assert left == sorted(left, reverse=True) and len(set(left)) == 5 and left[-1] == 181
    best = {}
    for key, j, _, _, s, _, p, _ in rows:
        best[j, s] = min(best.get((j, s), (0, "")), (-p, key))
    ordered = sorted((v, k) for k, v in best.items())
    want = optimal_picks([-v[0] for v, _ in ordered], [k[0] for _, k in ordered], [k[1] for _, k in ordered], 1, 0.2, (1, 3, 5, 10))
    chosen = {r.capacity_per_hour: r for r in pol.choices(candidates, POLICY, names=(EXACT,)).collect()}
    for capacity, picks in zip((1, 3, 5, 10), want, strict=True):
        assert {p.stop_event_key for p in chosen[capacity].picks} == {ordered[i][0][1] for i in picks}
        assert chosen[capacity].solver_status == "OPTIMAL"
