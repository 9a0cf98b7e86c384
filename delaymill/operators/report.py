"""Report measures as named aggregates, and report queries built from them.

Ratios are ratios of sums; where the denominator is zero they are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.functions.delays import share
from delaymill.operators.candidates import OUTCOME, PROBABILITY
from delaymill.operators.ranking import rank_rows
from delaymill.session import spool

Slicers = Sequence[Column | str]


def _rows(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _single(column: str) -> Column:
    """The value if the selection holds exactly one scenario."""
    one = F.min("scenario_key") == F.max("scenario_key")
    return F.when(one & (F.min(column) == F.max(column)), F.max(column))


def event_measures() -> dict[str, Column]:
    eligible, chosen, severe = F.col("is_eligible_candidate"), F.col("selected_for_review"), F.col(OUTCOME)
    events, reviewable, selected = _rows(), _rows(eligible), _rows(chosen)
    open_severe, chosen_severe = _rows(eligible & severe), _rows(chosen & severe)
    chosen_share, base_share = share(chosen_severe, selected), share(open_severe, reviewable)
    average = F.avg(PROBABILITY)
    return {
        "Event Count": events,
        "Eligible Event Count": reviewable,
        "Reviewable Event Count": reviewable,
        "Not Reviewable Event Count": events - reviewable,
        "Selected Event Count": selected,
        "Chosen Event Count": selected,
        "Actual Severe Event Count": _rows(severe),
        "Reviewable Severe Event Count": open_severe,
        "Selected Severe Event Count": chosen_severe,
        "Chosen Severe Event Count": chosen_severe,
        "Average Predicted Severe Probability": average,
        "Average Predicted Risk": average,
        "Average Reviewable Predicted Risk": F.avg(F.when(eligible, F.col(PROBABILITY))),
        "Reviewable Share": share(reviewable, events),
        "Chosen Share Of Reviewable": share(selected, reviewable),
        "Reviewable Severe Share": base_share,
        "Chosen Severe Share": chosen_share,
        "Chosen Severe Capture": share(chosen_severe, open_severe),
        "Chosen Lift Vs Reviewable Base": F.try_divide(chosen_share, base_share),
        "Scenario Selection Valid": F.coalesce((F.min("scenario_key") == F.max("scenario_key")).cast("int"), F.lit(0)),
        "Optimized at": F.max("optimized_at"),
        "Optimized At Display": _single("optimized_at"),
        "Stop events in this slice": events,
        "Stop events that became severe": _rows(severe),
        "Stop events eligible for review": reviewable,
        "Share of stop events eligible for review": share(reviewable, events),
        "Among eligible stop events, share that became severe": base_share,
    }


def scenario_measures() -> dict[str, Column]:
    """Measures that read the scenario dimension, for facts joined with it."""
    return {
        "Scenario Display": _single("scenario_display_name"),
        "Model Version Display": _single("model_version"),
        "Policy Version Display": _single("policy_version"),
    }


def horizon_measures() -> dict[str, Column]:
    selected, unused = F.sum("selected_event_count"), F.sum("unused_capacity")
    eligible = F.sum("eligible_candidate_count")
    severe, hits = F.sum("actual_severe_candidate_count"), F.sum("actual_severe_selected_count")
    prevalence, precision, used = share(severe, eligible), share(hits, selected), share(selected, selected + unused)
    return {
        "Selected Events": selected,
        "Eligible Events": eligible,
        "Candidate Severe Events": severe,
        "Selected Severe Events": hits,
        "Candidate Prevalence": prevalence,
        "Precision at Capacity": precision,
        "Severe-Delay Coverage": share(hits, severe),
        "Selection Lift": F.try_divide(precision, prevalence),
        "Capacity Utilization": used,
        "Review Slots": selected + unused,
        "Unused Review Slots": unused,
        "Available review slots left unused": unused,
        "Share of available review slots that were used": used,
    }



def report(fact: DataFrame, by: list[str], measures: dict[str, Column], slicers: Slicers = ()) -> DataFrame:
    """Measures of a fact by some axes under some filters; filters reach the scan."""
    for slicer in slicers:
        fact = fact.filter(slicer)
    return fact.groupBy(*by).agg(*[c.alias(name) for name, c in measures.items()])


def some(measures: dict[str, Column], *names: str) -> dict[str, Column]:
    return {name: measures[name] for name in names}


def with_dimension(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A fact with the attributes of a dimension that it does not hold itself."""
    new = [c for c in dimension.columns if c not in fact.columns]
    return fact.join(dimension.select(key, *new), key, "left")


def top_stations(fact: DataFrame, n: int = 10) -> DataFrame:
    counted = fact.groupBy("station_name").agg(F.count(F.lit(1)).alias("Event Count"))
    return counted.orderBy(F.desc("Event Count"), "station_name").limit(n)


def riskiest_events(fact: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` riskiest reviewable events with their dense rank; ties are cut by key.

    The rank is computed on the ``n`` rows only: all rows of a higher probability are among them.
    """
    top = fact.filter("is_eligible_candidate").orderBy(F.desc(PROBABILITY), F.asc("stop_event_key")).limit(n)
    return top.withColumn("risk_rank", F.dense_rank().over(Window.orderBy(F.desc(PROBABILITY))))


def risk_ranks(fact: DataFrame) -> DataFrame:
    """Dense rank of every reviewable event by probability; equal probabilities share a rank.

    Only the distinct probabilities are ranked, and joined back to their events.
    """
    events = fact.filter("is_eligible_candidate")
    levels = events.select(PROBABILITY).distinct()
    ranked = spool(rank_rows(levels, [], [F.desc(PROBABILITY)], "risk_rank"), "risk_levels")
    return events.join(ranked, PROBABILITY)


def review_queue(fact: DataFrame) -> DataFrame:
    columns = [
        "calendar_date",
        "hour_of_day",
        "selection_rank",
        "station_name",
        "train_type",
        "line_number",
        PROBABILITY,
        "Actual Outcome",
        "priority_score",
        "stop_event_key",
    ]
    chosen = fact.filter("selected_for_review").select(*columns)
    return chosen.orderBy("calendar_date", "hour_of_day", "selection_rank", "stop_event_key")


def date_hour_matrix(fact: DataFrame) -> DataFrame:
    """Events per date (rows) and hour (24 fixed columns)."""
    pivoted = fact.groupBy("calendar_date").pivot("hour_of_day", list(range(24))).agg(F.count(F.lit(1)))
    none = F.lit(0).cast("long")
    hours = [F.coalesce(F.col(str(h)), none).alias(f"h{h:02d}") for h in range(24)]
    return pivoted.select("calendar_date", *hours)


def slots_and_events_by_hour(
    event_fact: DataFrame, horizon_fact: DataFrame, event_slicers: Slicers = (), slicers: Slicers = ()
) -> DataFrame:
    """Chosen events and review slots by hour. Station and train slicers touch the events only."""
    chosen = report(
        event_fact, ["hour_of_day"], some(event_measures(), "Chosen Event Count"), [*slicers, *event_slicers]
    )
    slots = report(
        horizon_fact, ["hour_of_day"], some(horizon_measures(), "Review Slots", "Unused Review Slots"), slicers
    )
    joined = slots.join(chosen, "hour_of_day", "left")
    return joined.withColumn("Chosen Event Count", F.coalesce("Chosen Event Count", F.lit(0).cast("long")))


def policy_table(comparison_fact: DataFrame, capacity: int) -> DataFrame:
    return comparison_fact.filter(F.col("capacity_per_hour") == capacity).orderBy("policy_sort_order")
