"""Exact quantiles against sorted values."""

import random

import numpy as np
import pytest

from delaymill.operators import order_statistics
from delaymill.operators.order_statistics import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("short", [3, 1000])
def test_quantiles_equal_sorted_values(spark, monkeypatch, short):
    monkeypatch.setattr(order_statistics, "SHORT", short)
    rng = random.Random(short)
    n = 5000
    columns = {
        "plain": [rng.random() for _ in range(n)],
        "two": [float(rng.random() < 0.5) for _ in range(n)],
        "same": [7.0] * n,
        "huge": [rng.choice([1.0, -1.0]) * 10.0 ** rng.randrange(-200, 200) for _ in range(n)],
        "tied": [float(rng.choice([1, 2, 2, 2, 3, 900])) for _ in range(n)],
        "some": [rng.gauss(0, 1) if rng.random() < 0.01 else None for _ in range(n)],
        "none": [None] * n,
    }
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns))
    got = quantiles(frame, list(columns), SHARES)
    for name, values in columns.items():
        known = [v for v in values if v is not None]
        assert got[name] == (pytest.approx(np.quantile(known, SHARES).tolist()) if known else [None] * len(SHARES))


def test_quantiles_of_short_tables(spark):
    frame = spark.createDataFrame([(3,), (1,)], "`a b` int")
    assert quantiles(frame, ["a b"], SHARES) == {"a b": pytest.approx([1, 1.2, 1.5, 2, 2.5, 3])}
    assert quantiles(frame.limit(0), ["a b"], [0.5]) == {"a b": [None]}
    assert quantiles(frame, [], SHARES) == {}


def test_a_wrong_proposal_is_noticed():
    b = order_statistics.Bracket("x", 10, 0.0, 100.0)
    b._propose([float(v) for v in range(50, 50 + order_statistics.GRID)], 0.5)
    low = b.low
    b.narrow({"below": 20, "lowest": 1, "inside": 5, "highest": 1, "grid": None, "listed": None})
    assert (b.low, b.high, b.value) == (0.0, low, None)
    b = order_statistics.Bracket("x", 90, 0.0, 100.0)
    b._propose([float(v) for v in range(order_statistics.GRID)], 0.5)
    high = b.high
    b.narrow({"below": 20, "lowest": 1, "inside": 5, "highest": 1, "grid": None, "listed": None})
    assert (b.low, b.high, b.value) == (high, 100.0, None)
