"""The severe-delay classifier as a Spark ML pipeline, and its scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.operators.split import (
    ALLOWED_FEATURES,
    BOOLEAN,
    CATEGORICAL,
    EXCLUDED_FEATURES,
    NUMERIC,
    TARGET,
    TEST,
    TRAIN,
    VALIDATION,
    require_columns,
    typed_features,
)

MODEL_NAME = "logistic_regression"
MODEL_VERSION = "2026-06-28-v1"

# Stand-in for missing categories, and the iteration limit.
MISSING = "missing"
MAX_ITERATIONS = 1000


def medians(training: DataFrame) -> dict[str, float]:
    """Exact medians of the numeric features, each from one histogram of its few distinct values."""
    found = training.agg(*[F.percentile(F.nanvl(F.col(c), F.lit(None)), 0.5).alias(c) for c in NUMERIC]).first().asDict()
    unknown = [c for c, value in found.items() if value is None]
    if unknown:
        raise ValueError(f"features without a known value in training: {unknown}")
    return found


def fill_numbers(values: dict[str, float]) -> SQLTransformer:
    """A stage that keeps the fill values with the model: null and NaN become the value of their column."""
    filled = [f"coalesce(nanvl(`{c}`, CAST(NULL AS DOUBLE)), {float(v)!r}D) AS `{c}_known`" for c, v in values.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def severity_pipeline(n_train: int, middles: dict[str, float]) -> Pipeline:
    """Index and encode categories, impute and scale numbers, impute flags, then fit a logistic regression.

    Levels unseen in training become all-zero. The penalty is the one of a summed loss with unit weight,
    which for Spark's mean loss is one over the number of training rows.
    """
    leaks = set(ALLOWED_FEATURES) & set(EXCLUDED_FEATURES)
    if leaks:
        raise ValueError(f"features that leak the outcome: {sorted(leaks)}")
    indexed = [f"{c}_index" for c in CATEGORICAL]
    encoded = [f"{c}_code" for c in CATEGORICAL]
    numbers = [f"{c}_known" for c in NUMERIC]
    flags = [f"{c}_known" for c in BOOLEAN]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(CATEGORICAL), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        fill_numbers(middles),
        Imputer(inputCols=list(BOOLEAN), outputCols=flags, strategy="mode"),
        VectorAssembler(inputCols=numbers, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=[*encoded, "scaled", *flags], outputCol="features"),
        LogisticRegression(
            featuresCol="features",
            labelCol="label",
            maxIter=MAX_ITERATIONS,
            regParam=1.0 / n_train,
            standardization=False,
        ),
    ])


def model_input(rows: DataFrame) -> DataFrame:
    """Typed features with missing categories spelled out, and the target as label."""
    require_columns(rows, [*ALLOWED_FEATURES, TARGET], "model rows")
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in CATEGORICAL}
    flags = {c: F.col(c).cast("double") for c in BOOLEAN}
    return typed_features(rows).withColumns({**filled, **flags, "label": F.col(TARGET).cast("double")})


def fit(rows: DataFrame) -> PipelineModel:
    """Fit on the training split; both classes must occur."""
    training = model_input(rows.filter(F.col("prediction_split") == TRAIN))
    counts = training.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")).first()
    if not counts.n or counts.positives in (0, counts.n):
        raise ValueError("the train split must contain both positive and negative rows")
    return severity_pipeline(counts.n, medians(training)).fit(training)


def with_probability(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """Rows with their own columns and the probability of a severe departure delay."""
    kept = rows.columns
    probability = vector_to_array("probability")[1]
    carried = rows.withColumn("_row", F.struct(*kept))
    scored = model.transform(model_input(carried))
    return scored.select("_row.*", probability.alias(name))


def held_out_scores(
    model: PipelineModel, rows: DataFrame, threshold: float, scored_at: str, probability: str = "predicted_probability"
) -> DataFrame:
    """Validation and test rows as they are handed to the selection."""
    held_out = rows.filter(F.col("prediction_split").isin(VALIDATION, TEST))
    scored = with_probability(model, held_out, probability)
    return scored.withColumns({
        "predicted_is_departure_severe_delay": F.col(probability) >= threshold,
        "actual_is_departure_severe_delay": F.col(TARGET),
        "model_name": F.lit(MODEL_NAME),
        "model_version": F.lit(MODEL_VERSION),
        "selected_threshold": F.lit(float(threshold)),
        "scope_stage": F.lit("B"),
        "scope_evaluation_mode": F.lit("rebuilt_pipeline"),
        "scored_at": F.lit(scored_at),
    })


def frozen_scores(model: PipelineModel, rows: DataFrame, threshold: float) -> DataFrame:
    """All modelling rows scored by the frozen model, for the scope diagnostic."""
    column = f"stage_a_frozen_probability__{MODEL_NAME}__{MODEL_VERSION}"
    scored = with_probability(model, rows, column)
    return scored.withColumns({
        "stage_a_predicted_severe_delay_probability": F.col(f"`{column}`"),
        "stage_a_selected_by_frozen_threshold": F.col(f"`{column}`") >= threshold,
    })


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
