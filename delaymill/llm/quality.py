"""Operator 10: quality classifier, a sparse ensemble of rules taken from trees."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import held_out, portions, shielded, texts, unit_hash
from delaymill.session import spool

STATISTICS = (
    "log_bytes",
    "log_words",
    "upper",
    "digit",
    "punctuation",
    "space",
    "non_ascii",
    "top_punctuation",
    "byte_entropy",
    "word_bytes",
    "distinct_words",
    "commonest_word",
    "repeated_neighbours",
    "short_words",
    "bare_words",
    "repeated_lines",
    "line_bytes",
)
SAMPLE = 6000  # expected labelled rows to learn from
TREES, DEPTH = 12, 3
PENALTY = 0.002
CUT = 0.7

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_HIGH = _BYTES >= 128
_MARKS = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)


def statistics_of(text: str) -> list[float]:
    """The values of ``STATISTICS`` of a whole text; all zero for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    counts = np.bincount(raw, minlength=256)
    share = counts / len(raw)
    some = share[share > 0]
    words = text.split()
    n = max(1, len(words))
    tally = Counter(words)
    lines = text.split("\n")
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        float(share[_UPPER].sum()),
        float(share[_DIGIT].sum()),
        float(share[_MARKS].sum()),
        float(share[_SPACE].sum()),
        float(share[_HIGH].sum()),
        float(share[_MARKS].max()),
        float(-(some * np.log2(some)).sum()),
        float((len(raw) - counts[_SPACE].sum()) / n),
        len(tally) / n,
        max(tally.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(len(w) <= 3 for w in words) / n,
        sum(map(str.isalpha, words)) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(raw) / len(lines)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and a struct ``_statistics`` computed from the whole ``text``."""
    columns = docs.columns
    at = columns.index("text")

    def add(batches):
        for batch in portions(batches):
            values = np.array([statistics_of(t) for t in texts(batch.column(at))], float)
            values = values.reshape(batch.num_rows, len(STATISTICS))
            struct = pa.StructArray.from_arrays([pa.array(v) for v in values.T], STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*columns, "_statistics"])

    fields = ", ".join(f"`{s}`: double" for s in STATISTICS)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{kept}, `_statistics` struct<{fields}>")


@dataclass(frozen=True)
class Condition:
    """One step of a tree path: a statistic at most, or above, a value."""

    statistic: int
    above: bool
    value: float

    def column(self) -> Column:
        held = F.col(f"_statistics.{STATISTICS[self.statistic]}")
        return held > self.value if self.above else held <= self.value


Rule = frozenset  # of conditions, all of which must hold


def rule_column(rule: Rule) -> Column:
    ordered = sorted(rule, key=lambda c: (c.statistic, c.above, c.value))
    return reduce(lambda a, b: a & b, [c.column() for c in ordered])


def tree_rules(forest) -> list[Rule]:
    """Every path from a root to an inner or end node of a fitted forest, as a conjunction; none twice."""
    found: dict[Rule, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found.setdefault(_tightest(path))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            at, value = split.featureIndex(), split.threshold()
            walk(node.leftChild(), (*path, Condition(at, False, value)))
            walk(node.rightChild(), (*path, Condition(at, True, value)))

    for tree in forest._java_obj.trees():
        walk(tree.rootNode(), ())
    return list(found)


def _tightest(path: tuple) -> Rule:
    """Of conditions on the same side of the same statistic only the narrowest."""
    kept: dict = {}
    for c in path:
        old = kept.get((c.statistic, c.above))
        if old is None or (c.value > old.value) == c.above:
            kept[c.statistic, c.above] = c
    return frozenset(kept.values())


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over ``_statistics``."""
        terms = [F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learn from about ``sample`` labelled documents, chosen by a hash of the id; of rows that share an id one is learnt from.

    ``labels`` has doc_id and quality (0, 1; null and repeated labels are ignored, of contradictory ones the smaller holds). With no
    label of one kind, or with texts that no tree can tell apart, the score is the share of label 1 (one half without labels).
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    size = known.count()
    chosen = known.filter(unit_hash(F.col("doc_id"), F.lit("quality")) < F.lit(sample / max(1, size)))
    picked = chosen.select(F.col("doc_id").alias("_label_id"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_label_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    vector = array_to_vector(F.array(*[F.col(f"_statistics.{s}") for s in STATISTICS]))
    stored = spool(
        with_statistics(rows.select("doc_id", "text", "label")).select("doc_id", "label", "_statistics"), "quality"
    )
    shares = {r.label: r.n for r in stored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return _constant(0.5 if not shares else float(next(iter(shares))))
    training = stored.select("label", vector.alias("features"), "_statistics").coalesce(4)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="onethird", maxBins=64
    ).fit(training)
    rules = tree_rules(forest)
    if not rules:
        return _constant(shares[1.0] / sum(shares.values()))
    held = array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules]))
    lasso = LogisticRegression(
        labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=PENALTY, maxIter=40, standardization=False
    ).fit(training.select("label", held.alias("rules")))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), tuple(weights))


def _constant(share: float) -> RuleModel:
    share = max(0.01, min(0.99, share))
    return RuleModel(math.log(share / (1 - share)), ())


@shielded("_statistics", "_score")
def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of ``docs`` and ``_score``, the probability that its text has label 1."""
    return with_statistics(docs).withColumn("_score", model.score()).drop("_statistics")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``cut`` on) of every row; no label that is held out is learnt.

    Null texts score as empty ones; repeated rows and null ids give one row each; columns other than doc_id
    and text are not looked at.
    """
    model = train(docs, labels.filter(~held_out()), sample)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= cut).cast("int").alias("predicted"),
    )


@shielded("_statistics", "_score")
def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score at least ``cut``."""
    scored = score(docs, train(docs, labels.filter(~held_out()), sample))
    return scored.filter(F.col("_score") >= cut).select(*[f"`{c}`" for c in docs.columns])
