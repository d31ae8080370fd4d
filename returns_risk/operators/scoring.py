"""The clipped linear score, gradient-boosted trees, and scoring of new rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from returns_risk import constants as c
from returns_risk.functions.numeric import rounded_like_text, safe_ratio
from returns_risk.operators.boosting import score_trees
from returns_risk.operators.features import sanitize
from returns_risk.sources.store import newest_version, open_version, publish_version, write_version

_DOUBLES = {
    "TotalPurchaseValue", "TotalRefundValue", "RefundRate_by_Items", "RefundRate_by_Value",
    "AvgTicketSentimentScore", "MinTicketSentimentScore",
}
FEATURE_SCHEMA = StructType([
    StructField(c.CUSTOMER, LongType()),
    *[StructField(name, DoubleType() if name in _DOUBLES else LongType()) for name in c.FEATURES],
])


def linear_sum(weights: Mapping[str, float], source: Callable[[str], str] = str) -> str:
    """SQL text: the weighted sum of the features, clipped to the score range.

    ``source`` turns a feature name into the expression that holds its value.
    """
    low, high = c.SCORE_RANGE
    total = " + ".join(f"{source(name)} * ({float(weight)!r}D)" for name, weight in weights.items())
    return f"greatest({low}D, least({high}D, {total}))"


def _with_class(df: DataFrame, threshold: float = c.CLASS_THRESHOLD) -> DataFrame:
    df = df.drop(c.PREDICTION)
    return df.selectExpr("*", f"int({c.PROBABILITY} > {threshold}D) AS {c.PREDICTION}")


def linear_score(df: DataFrame, weights: Mapping[str, float] = c.SCORE_WEIGHTS) -> DataFrame:
    """Adds probability and class of the linear score, in place of any that are there. The other class has 1 - probability."""
    return _with_class(sanitize(df).drop(c.PROBABILITY).selectExpr("*", f"{linear_sum(weights)} AS {c.PROBABILITY}"))


def save_linear(spark: SparkSession, path: str, weights: Mapping[str, float] = c.SCORE_WEIGHTS) -> None:
    """Publishes the weights of a linear score, a table of (feature, weight), as the newest version under ``path``."""
    write_version(spark.createDataFrame(list(weights.items()), "feature string, weight double").coalesce(1), path)


def load_linear(spark: SparkSession, path: str) -> dict[str, float]:
    stored = {row.feature: row.weight for row in spark.read.parquet(newest_version(spark, path)).collect()}
    return {name: stored[name] for name in (*c.SCORE_WEIGHTS, *stored) if name in stored}


def train_gbt(labelled: DataFrame, label: str = c.LABEL, seed: int = c.SEED, **params) -> PipelineModel:
    """Gradient-boosted trees on the seventeen features. ``params`` go to ``GBTClassifier``."""
    assembler = VectorAssembler(inputCols=list(c.FEATURES), outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, predictionCol="_prediction", seed=seed, **params
    ).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return Pipeline(stages=[assembler, trees]).fit(sanitize(labelled).select(label, *c.FEATURES))


def score_gbt(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds probability and class of the trees. The class is 1 above one half."""
    scored = model.transform(sanitize(df))
    scored = scored.withColumn(c.PROBABILITY, vector_to_array("_probability")[1])
    return _with_class(scored.drop("_features", "_raw", "_probability", "_prediction"))


def save_model(model: PipelineModel, path: str) -> None:
    """Publishes Spark's trees as the newest version under ``path``: a reader sees the version before, or this one whole."""
    spark = SparkSession.active()
    folder = open_version(spark, path)
    model.write().save(folder)
    publish_version(spark, folder)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(newest_version(SparkSession.active(), path))


def score_features(df: DataFrame, scorer: PipelineModel | DataFrame | Mapping[str, float] = c.SCORE_WEIGHTS) -> DataFrame:
    """Probability and class of ready feature rows, by Spark's trees, a stored table of trees, or linear weights."""
    if isinstance(scorer, DataFrame):
        return score_trees(df, scorer)
    return score_gbt(df, scorer) if isinstance(scorer, PipelineModel) else linear_score(df, scorer)


def typed_in_rates(df: DataFrame) -> DataFrame:
    """Refund rates as for typed-in rows: a denominator of 0 counts as 1, two decimals."""
    items = safe_ratio("TotalItemsReturned", "TotalItemsPurchased", "unit")
    value = safe_ratio("TotalRefundValue", "TotalPurchaseValue", "unit")
    return df.withColumns({
        "RefundRate_by_Items": F.expr(rounded_like_text(items)),
        "RefundRate_by_Value": F.expr(rounded_like_text(value)),
    })


def feature_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Feature rows from literal values: a customer number and the seventeen features in order."""
    kinds = [float if field.name in _DOUBLES else int for field in FEATURE_SCHEMA]
    typed = [
        tuple(None if value is None else kind(value) for kind, value in zip(kinds, row, strict=True))
        for row in rows
    ]
    return spark.createDataFrame(typed, FEATURE_SCHEMA)


def flag_accounts(scored: DataFrame, threshold: float = c.FLAG_THRESHOLD) -> DataFrame:
    """Adds ``flagged``: probability strictly above the threshold."""
    return scored.selectExpr("*", f"{c.PROBABILITY} > {threshold}D AS flagged")
