"""Operator 1: mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import narrowed, shielded
from delaymill.session import spool

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.8  # default targets: shares of the corpus to this power
TOLERANCE = 1e-9  # largest relative distance of a marginal from its target at which raking ends
SWEEPS = 200
STALLED = 0.999  # raking also ends when sweeps no longer get closer: not all targets can be met together
CHECKED = 4  # sweeps between two looks at the marginals
SEED = 17
FRACTION = 0.5  # of the corpus' tokens that a sample has, if every cell has enough

# The default topics, the first that applies counts; ``n`` is the number of tokens.
TOPICS = (
    ("empty", "n = 0"),
    ("licensed", "contains(t, 'Licensed under')"),
    ("tabular", "contains(t, ' | ')"),
    ("contact", "contains(t, '@')"),
    ("note", "n < 120"),
    ("article", "n < 600"),
)
OTHER_TOPIC = "long read"
UNKNOWN = "unknown"
TOKEN = r"[^ \t\n\r]+"


def default_topic(text: Column, tokens: Column) -> Column:
    """The kind of a text by the rules of ``TOPICS``."""
    tests = {
        "empty": tokens == 0,
        "licensed": text.contains("Licensed under"),
        "tabular": text.contains(" | "),
        "contact": text.contains("@"),
        "note": tokens < 120,
        "article": tokens < 600,
    }
    return reduce(lambda chain, rule: chain.when(tests[rule[0]], F.lit(rule[0])), TOPICS, F).otherwise(F.lit(OTHER_TOPIC))


def described(docs: DataFrame, topic=default_topic) -> DataFrame:
    """All columns of ``docs`` and ``_tokens``, ``_source``, ``_lang`` and ``_topic``, null labels as ``unknown``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    labels = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in ("source", "lang")}
    return docs.withColumn("_tokens", tokens).withColumns({**labels, "_topic": topic(text, F.col("_tokens"))})


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets proportional to a power of the corpus shares."""
    sums = cells.groupBy(f"_{dimension}").agg(F.sum("_cell_tokens").alias("_n"))
    raised = sums.filter("_n > 0").select(F.col(f"_{dimension}").alias("value"), F.pow(F.col("_n").cast("double"), power).alias("share"))
    return raised


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``_weight``: token weights whose shares by every dimension are the targets'.

    Starts from the token counts and scales one dimension after the other until every marginal is within
    ``tolerance`` of its target. Targets are (value, share) tables; they are taken relative to the values that the corpus has, a value
    without target gets weight 0. Marginals are aggregates of the cells joined back, so any number of sources fits.
    """
    current = cells.withColumn("_weight", F.col("_cell_tokens").cast("double"))
    for d, wanted in targets.items():
        present = cells.filter("_cell_tokens > 0").select(F.col(f"_{d}").alias("value")).distinct()
        kept = narrowed(wanted.groupBy("value").agg(F.sum("share").alias("share")).join(present, "value", "left_semi"))
        total = kept.agg(F.sum("share").alias("_all"))
        goal = spool(
            kept.join(F.broadcast(total)).select(F.col("value").alias(f"_{d}"), (F.col("share") / F.col("_all")).alias(f"_goal_{d}")),
            "goal",
        )
        current = current.join(goal, f"_{d}", "left")
    current = spool(current, "weights")
    columns = current.columns
    before = float("inf")
    for sweep in range(1, SWEEPS + 1):
        for d in targets:
            factor = F.when(F.col("_sum") > 0, F.coalesce("_goal", F.lit(0.0)) / F.col("_sum")).otherwise(F.lit(0.0))
            factors = _marginals(current, d).select(f"_{d}", factor.alias("_f"))
            scaled = current.join(factors, f"_{d}").withColumn("_weight", F.col("_weight") * F.col("_f"))
            current = spool(scaled.select(*columns), "weights")
        if sweep % CHECKED:
            continue
        far = _distance(current, targets)
        if far <= tolerance or far > STALLED * before:
            break
        before = far
    return current.select(*cells.columns, "_weight")


def _marginals(cells: DataFrame, dimension: str) -> DataFrame:
    """The weight ``_sum`` and the goal ``_goal`` (null without one) of each value of a dimension; every cell has its goals with it."""
    sums = cells.groupBy(f"_{dimension}").agg(F.sum("_weight").alias("_sum"), F.max(f"_goal_{dimension}").alias("_goal"))
    return narrowed(sums)


def _distance(cells: DataFrame, dimensions: Iterable[str]) -> float:
    """The largest relative distance of a marginal of the weights from its goal."""
    parts = []
    for d in dimensions:
        sums = _marginals(cells, d).filter(F.col(f"_{d}").isNotNull() & F.col("_goal").isNotNull())
        parts.append(sums.agg(F.max(F.abs(F.col("_sum") / F.col("_goal") - 1)).alias("far")))
    return reduce(DataFrame.unionByName, parts).agg(F.max("far")).first()[0] or 0.0


def sampling_number(seed: int) -> Column:
    """A number in [0, 1) for each document; rows of one id share it, rows without id take it from their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce(F.col("text"), F.lit(""))))
    digits = F.substring(F.md5(F.concat(name, F.lit(f" {seed}")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


@shielded("_tokens", "_source", "_lang", "_topic", "_share", "_probability", "_copies", "_expected", "_cell_tokens", "_weight", "_rate", "_all")
def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    power: float = TEMPER,
    seed: int = SEED,
    topic=default_topic,
    fraction: float = FRACTION,
) -> DataFrame:
    """Sampled rows of ``docs``, all columns, with ``_tokens``, ``_source``, ``_lang``, ``_topic``, ``_share``, ``_probability``, ``_copies``.

    ``_share`` is the raked share of the row's cell (source, language, topic) of all token weight. A row belongs into the
    sample ``_copies`` times: on average as often as its cell's weight per token asks for, so that the expected tokens of
    the sample, copies counted, are ``fraction`` of the corpus with the target marginals. In a cell that has fewer tokens
    than its share of that, every row has the whole part of this average as copies and one more by a draw on the rest.
    ``_probability`` is the chance of a row to have any copy; ``repeated`` writes copies out. ``targets`` maps a dimension to a table (value, share); the others
    are the corpus shares to ``power``. Null labels are ``unknown``. Null and empty texts have no tokens,
    change no weight and are not sampled; rows that repeat an id are kept or left together; an empty table gives no
    rows. Columns of ``docs`` with the name of an added one are replaced by it.
    """
    names = docs.columns
    rows = described(docs, topic)
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = spool(narrowed(rows.groupBy(*keys).agg(F.sum("_tokens").alias("_cell_tokens"))), "cells").filter("_cell_tokens > 0")
    wanted = {d: (targets or {}).get(d, tempered(cells, d, power)) for d in DIMENSIONS}
    raked = rake(cells, wanted).withColumn("_rate", F.col("_weight") / F.col("_cell_tokens"))
    whole = F.broadcast(raked.agg(F.sum("_cell_tokens").alias("_all")))  # one row
    expected = F.lit(fraction) * F.col("_rate") * F.col("_all")
    probability = F.least(F.lit(1.0), expected)
    cell = raked.join(whole).select(
        *keys, F.col("_weight").alias("_share"), probability.alias("_probability"), expected.alias("_expected")
    )
    cell = spool(cell, "probabilities")
    sampled = rows.join(cell, keys).filter((sampling_number(seed) < F.col("_probability")) & (F.col("_tokens") > 0))
    least = F.floor("_expected")
    copies = least + (sampling_number(seed) < F.col("_expected") - least).cast("long")
    return sampled.select(*[f"`{c}`" for c in names], "_tokens", *keys, "_share", "_probability", copies.alias("_copies"))


def repeated(sample: DataFrame, copies: str = "_copies") -> DataFrame:
    """Every row of a sample as often as its ``copies`` say, without that column."""
    return sample.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(copies)


def oracle(
    documents: str = "documents",
    sweeps: int = 40,
    power: float = TEMPER,
    seed: int = SEED,
    fraction: float = FRACTION,
    copies: bool = False,
) -> str:
    """The rows of the default mixture as SQL, with raking written out ``sweeps`` times; on demand with their copies."""
    topic = " ".join(f"WHEN {test} THEN '{name}'" for name, test in TOPICS)
    parts = [
        f"""rows AS (
  SELECT doc_id, source, lang, t, n, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic FROM (
    SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS t,
           len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM {documents}))""",
        "cells AS (SELECT source, lang, topic, sum(n) AS n FROM rows GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for d in DIMENSIONS:
        parts.append(
            f"goal_{d} AS (SELECT {d}, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS goal FROM cells GROUP BY {d})"
        )
    parts.append("w0 AS MATERIALIZED (SELECT *, CAST(n AS DOUBLE) AS w FROM cells)")
    step = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, c.w * g.goal / sum(c.w) OVER (PARTITION BY c.{d}) AS w"
                f" FROM w{step} c JOIN goal_{d} g ON c.{d} = g.{d})"
            )
            step += 1
    parts.append(f"p AS (SELECT source, lang, topic, w, least(1.0, {fraction} * (w / n) * CAST(sum(n) OVER () AS DOUBLE)) AS p FROM w{step})")
    expected = f"{fraction} * (w / n) * CAST(sum(n) OVER () AS DOUBLE)"
    if copies:
        parts.append(f"e AS (SELECT source, lang, topic, {expected} AS expected FROM w{step})")
    number = (
        f"CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), concat('text ', t)), ' {seed}')), 1, 12)) AS BIGINT)"
        f" / {16**12}.0"
    )
    drawn = f",\n CAST(floor(expected) AS BIGINT) + CASE WHEN {number} < expected - floor(expected) THEN 1 ELSE 0 END AS copies" if copies else ""
    also = " JOIN e USING (source, lang, topic)" if copies else ""
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, CAST(n AS BIGINT) AS n_tokens, round(w, 6) AS share, round(p, 6) AS probability{drawn}
FROM rows JOIN p USING (source, lang, topic){also} WHERE {number} < p AND n > 0"""
    )
