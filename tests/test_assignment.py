"""The exact choice and the pool against brute force."""

import random
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from delaymill.operators.assignment import SCALE, optimal_picks, proved_picks, station_prices

rows_strategy = st.lists(
    st.tuples(st.integers(0, 20), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=9
)


def ordered(rows):
    """Priority order, one row per journey and station."""
    best = {}
    for key, (p, j, s) in enumerate(rows):
        best.setdefault((j, s), []).append((-p, key))
    kept = sorted((min(v), k) for k, v in best.items())
    return [(-value / 20, f"J{j}", f"S{s}") for (value, _), (j, s) in kept]


def brute(rows, preferred, penalty, k):
    target = min(k, len({j for _, j, _ in rows}))
    fine = round(penalty * SCALE)

    def rank(chosen):
        load = {}
        for i in chosen:
            load[rows[i][2]] = load.get(rows[i][2], 0) + 1
        excess = sum(max(0, n - preferred) for n in load.values())
        worth = sum(round(rows[i][0] * SCALE) for i in chosen) - fine * excess
        return (-worth, sum(1 << i for i in chosen))

    options = [c for c in combinations(range(len(rows)), target) if len({rows[i][1] for i in c}) == target]
    return list(min(options, key=rank))


@settings(max_examples=400, deadline=None)
@given(rows_strategy, st.integers(1, 2), st.sampled_from([0.0, 0.05, 0.1, 0.2, 0.45]))
def test_optimal_picks_equal_brute_force(raw, preferred, penalty):
    rows = ordered(raw)
    p, j, s = zip(*rows)
    got = optimal_picks(p, j, s, preferred, penalty, (1, 2, 3, 5))
    assert [sorted(g) for g in got] == [brute(rows, preferred, penalty, k) for k in (1, 2, 3, 5)]


def pooled(rows, k):
    """The pool rules on a priority-ordered list."""
    by_station, by_journey, kept = {}, {}, []
    for row in rows:
        by_station.setdefault(row[2], []).append(row)
    rows = [r for r in rows if r in by_station[r[2]][:k]]
    for row in rows:
        by_journey.setdefault(row[1], []).append(row)
    rows = [r for r in rows if r in by_journey[r[1]][:k]]
    kept = rows[: 2 * k * (k - 1) + 1]
    return kept


def test_pool_rules_never_change_the_optimum():
    draw = random.Random(5)
    for _ in range(300):
        raw = [(draw.randint(0, 20), draw.randint(0, 6), draw.randint(0, 3)) for _ in range(12)]
        rows = ordered(raw)
        k = draw.choice([1, 2, 3])
        preferred, penalty = draw.choice([1, 2]), draw.choice([0.0, 0.1, 0.3])
        best = [rows[i] for i in brute(rows, preferred, penalty, k)]
        pool = pooled(rows, k)
        assert set(best) <= set(pool)
        assert [pool[i] for i in brute(pool, preferred, penalty, k)] == best


def objective(rows, chosen, preferred, penalty):
    load = {}
    for i in chosen:
        load[rows[i][2]] = load.get(rows[i][2], 0) + 1
    return sum(round(rows[i][0] * SCALE) for i in chosen) - round(penalty * SCALE) * sum(max(0, n - preferred) for n in load.values())


def bound(rows, k, place, prices, preferred):
    """The dual objective, an upper bound for every choice of k rows."""
    gains = {}
    for (p, j, _), v in zip(rows, prices, strict=True):
        gains[j] = max(gains.get(j, 0), round(p * SCALE) - place - v)
    return k * place + preferred * sum({s: v for (_, _, s), v in zip(rows, prices, strict=True)}.values()) + sum(gains.values())


@settings(max_examples=300, deadline=None)
@given(rows_strategy, st.integers(1, 2), st.sampled_from([0.0, 0.05, 0.1, 0.2, 0.45]), st.sampled_from([None, 0, 1]))
def test_choices_are_proved_if_and_only_if_they_are_optimal(raw, preferred, penalty, steps):
    rows = ordered(raw)
    p, j, s = zip(*rows)
    for k, (picks, place, prices) in zip((1, 2, 3, 5), proved_picks(p, j, s, preferred, penalty, (1, 2, 3, 5), steps), strict=True):
        best = objective(rows, brute(rows, preferred, penalty, k), preferred, penalty)
        held = objective(rows, picks, preferred, penalty)
        assert len(picks) == min(k, len(set(j))) and held <= best
        assert (prices is not None) == (held == best)
        if prices is not None:
            assert all(0 <= v <= round(penalty * SCALE) for v in prices)
            assert bound(rows, len(picks), place, prices, preferred) == best
        if steps is None:
            assert held == best


def test_no_prices_for_a_worse_choice():
    rows = [("J1", "S1"), ("J2", "S1"), ("J3", "S2")]
    assert station_prices(rows, [90, 80, 70], [0, 1], 1, 30) is None
    assert station_prices(rows, [90, 80, 70], [0, 2], 1, 30) is not None
