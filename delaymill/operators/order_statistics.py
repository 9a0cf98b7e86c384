"""Exact quantiles of many columns in a few passes, in memory that does not grow with the data.

Each wanted rank of a column keeps a bracket, two values between which it lies. A pass over the table counts for
every bracket, in one aggregate, the rows below it, on its ends and inside it, and sketches the inside; the exact counts then
tell where the rank is, and the sketch proposes the next, narrower bracket. A sketch may be wrong: the counts of the next
pass show it, and the rank falls back to the part beside. Every pass drops the ends of a bracket from its inside, so equal values, however
many, end the search too. The inside is sent as a list only when the counts prove it short.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 1000  # rows inside a bracket that are listed
GRID = 64  # values of a sketch that propose brackets
ACCURACY = 2000


@dataclass
class Bracket:
    """The search for the value of one rank (from 0) of a column; the inside lies strictly between ``low`` and ``high``."""

    column: str
    rank: int
    low: float
    high: float
    outer: tuple[float, float] = (-math.inf, math.inf)  # the bracket before
    short: bool = False
    value: float | None = None

    def narrow(self, row: dict) -> None:
        below, lowest, inside = row["below"], row["lowest"], row["inside"]
        if self.rank < below:
            self.low, self.high = self.outer[0], self.low
        elif self.rank < below + lowest:
            self.value = self.low
        elif self.rank < below + lowest + inside:
            at = self.rank - below - lowest
            if row["listed"] is not None:
                self.value = row["listed"][at]
                return
            self.short = inside <= SHORT
            if not self.short:
                self._propose(row["grid"], at / inside)
        elif self.rank < below + lowest + inside + row["highest"]:
            self.value = self.high
        else:
            self.low, self.high = self.high, self.outer[1]

    def _propose(self, grid: list[float], share: float) -> None:
        i = share * (GRID - 1)
        self.outer = self.low, self.high
        self.low, self.high = grid[max(0, math.floor(i) - 1)], grid[min(GRID - 1, math.ceil(i) + 1)]


def _number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _looked_at(b: Bracket) -> Column:
    """What a pass finds out about one bracket."""
    x, low, high = _number(b.column), F.lit(b.low), F.lit(b.high)
    inside = F.when((x > low) & (x < high), x)
    apart = b.low != b.high
    grid = F.percentile_approx(inside, [i / (GRID - 1) for i in range(GRID)], ACCURACY)
    listed = F.array_sort(F.collect_list(inside))
    return F.struct(
        F.count_if(x < low).alias("below"),
        F.count_if(x == low).alias("lowest"),
        F.count(inside).alias("inside"),
        (F.count_if(x == high) if apart else F.lit(0).cast("long")).alias("highest"),
        (F.lit(None).cast("array<double>") if b.short else grid).alias("grid"),
        (listed if b.short else F.lit(None).cast("array<double>")).alias("listed"),
    )


def _single(name: str) -> Column:
    x = _number(name)
    return F.struct(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """For each column the values at the given shares, between neighbours in proportion; nulls are left out, NaN is largest.

    Only counts, bounded sketches and lists of at most ``SHORT`` values reach the driver. Ends of columns without values are None.
    """
    if not columns:
        return {}
    ends = df.agg(*[_single(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    places: dict[str, list[tuple[int, float]]] = {}
    brackets: dict[tuple[str, int], Bracket] = {}
    for c, found in zip(columns, ends, strict=True):
        places[c] = []
        for share in shares if found.n else []:
            at = share * (found.n - 1)
            places[c].append((math.floor(at), at - math.floor(at)))
            for rank in {math.floor(at), math.ceil(at)}:
                brackets[c, rank] = Bracket(c, rank, found.low, found.high)
    while waiting := [b for b in brackets.values() if b.value is None]:
        looks: dict[tuple, list[Bracket]] = {}
        for b in waiting:  # brackets that are still equal are counted once
            looks.setdefault((b.column, b.low, b.high, b.short), []).append(b)
        row = df.agg(*[_looked_at(same[0]).alias(f"b{i}") for i, same in enumerate(looks.values())]).first()
        for found, same in zip(row, looks.values(), strict=True):
            for b in same:
                b.narrow(found.asDict())
    return {c: _between(c, places[c], brackets) if places[c] else [None] * len(shares) for c in columns}


def _between(column: str, places: list[tuple[int, float]], brackets: dict) -> list[float]:
    out = []
    for rank, part in places:
        low = brackets[column, rank].value
        out.append(low if part == 0 else low + (brackets[column, rank + 1].value - low) * part)
    return out
