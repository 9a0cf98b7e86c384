"""Display labels of the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from delaymill.config import EXACT, GREEDY, RANDOM, SCORE_FIRST, Policy

# What a missing attribute is shown as.
UNKNOWN_STATION = "Unknown station"
UNKNOWN = "Unknown"
NO_LINE = "Not provided in source"

# Codes of solver statuses. A time limit with a known solution has a code of its own.
STATUS_CODES = {"OPTIMAL": 2, "DETERMINISTIC": 1, "TIME_LIMIT_WITH_INCUMBENT": 9}

# Display name and sort order of each policy.
POLICY_DISPLAY = {
    RANDOM: ("Random", 1),
    SCORE_FIRST: ("ML-first", 2),
    GREEDY: ("Constrained greedy", 3),
    EXACT: ("Exact", 4),
}

# Width of a probability bin.
BIN_WIDTH = 0.05


def review_eligibility(eligible: Column) -> Column:
    return F.when(eligible, "Can be reviewed").otherwise("Not reviewable")


def review_decision(eligible: Column, selected: Column) -> Column:
    picked = F.when(selected, "Chosen for review").otherwise("Not chosen for review")
    return F.when(eligible, picked).otherwise("Not reviewable")


def actual_outcome(severe: Column) -> Column:
    return F.when(severe, "Became severe").when(~severe, "Did not become severe").otherwise("Outcome unavailable")


def risk_band(p: Column) -> Column:
    """Ten bands of ten percent; comparisons with the written limits decide, not divisions."""
    label = F.when(p.isNull(), UNKNOWN)
    for tenth in range(9):
        label = label.when(p < (tenth + 1) / 10, f"{tenth}0-{tenth + 1}0%")
    return label.otherwise("90-100%")


def risk_band_sort(p: Column) -> Column:
    """Sort position of a band; multiplies before truncating, as the shown bands are sorted."""
    return F.when(p.isNull(), 99).otherwise(F.least(F.lit(10), (p * 10).cast("int") + 1))


def probability_bin(p: Column) -> Column:
    """Lower end of the bin by floor division of doubles, in which 1.0 belongs to the bin at 0.95."""
    steps = F.round((p - F.pmod(p, F.lit(BIN_WIDTH))) / BIN_WIDTH)
    return steps * BIN_WIDTH


def status_code(status: Column) -> Column:
    """Numeric codes stay; known names become codes; anything else is an error.

    Names come first: a cast that fails costs an exception per row.
    """
    code = status.cast("string").try_cast("int")
    name = F.upper(status.cast("string"))
    named = F.lit(None).cast("int")
    for known, number in STATUS_CODES.items():
        named = F.when(name == known, number).otherwise(named)
    error = F.raise_error(F.concat(F.lit("unsupported solver status: "), F.coalesce(name, F.lit("null"))))
    return F.coalesce(named, code, error.cast("int"))


def _of_policy(name: Column, place: int, kind: str, exact: str) -> Column:
    result = F.raise_error(F.concat(F.lit("unknown policy: "), name)).cast(kind)
    for policy, shown in POLICY_DISPLAY.items():
        result = F.when(name == (exact if policy == EXACT else policy), F.lit(shown[place])).otherwise(result)
    return result


def policy_display_name(name: Column, exact: str = EXACT) -> Column:
    return _of_policy(name, 0, "string", exact)


def policy_sort_order(name: Column, exact: str = EXACT) -> Column:
    return _of_policy(name, 1, "int", exact)


def scenario_display_name(policy: Policy) -> Column:
    return F.format_string(
        "Prototype %s | threshold %.2f | policy %s",
        F.lit(policy.capacity_scenario),
        F.lit(float(policy.threshold)),
        F.lit(policy.search.optimization_policy_version),
    )
