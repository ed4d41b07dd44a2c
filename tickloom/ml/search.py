"""Models and parameter search over feature tables, on the Spark ML library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7


def _features(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")


def train_entry(df: DataFrame, columns: Sequence[str], label: str = "target", weight: str | None = None, trees: int = 30, depth: int = 5) -> PipelineModel:
    """Three-class model: none, buy, sell."""
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, probabilityCol="_probability")
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[_features(columns), forest]).fit(df)


def train_exit(df: DataFrame, columns: Sequence[str], label: str = "label", rounds: int = 10, depth: int = 4) -> PipelineModel:
    """Two-class model: hold or close."""
    boosted = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[_features(columns), boosted]).fit(df)


def score_entry(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """``p_buy``, ``p_sell`` and ``signal`` (1, -1, 0): the likelier side where it reaches the threshold and is not tied."""
    scored = model.transform(df).withColumn("_p", vector_to_array("_probability"))
    buy, sell = F.get("_p", F.lit(1)), F.coalesce(F.get("_p", F.lit(2)), F.lit(0.0))
    signal = F.when((buy >= threshold) & (buy > sell), 1).when((sell >= threshold) & (sell > buy), -1).otherwise(0)
    return scored.withColumns({"p_buy": buy, "p_sell": sell, "signal": signal}).drop("_p", "_features", "_probability", "rawPrediction", "prediction")


def score_exit(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """``p_close`` and ``close``: whether the likelihood that closing now is better reaches the threshold."""
    scored = model.transform(df).withColumn("p_close", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("close", F.col("p_close") >= threshold).drop("_features", "probability", "rawPrediction", "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    """The model in a folder that the cluster shares; a model that is there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, map(float, found)), key=lambda x: -x[1])


def trials(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: int = SEED) -> DataFrame:
    """n random parameter sets, the same for the same seed, drawn by hash so that any number of tasks draws alike."""
    unit = [F.pmod(F.xxhash64(F.col("trial"), F.lit(f"{seed}:{name}")), F.lit(1 << 30)) / float(1 << 30) for name in ranges]
    own = spark.range(n).withColumnRenamed("id", "trial")
    return own.select("trial", *[(u * (hi - lo) + lo).alias(name) for u, (name, (lo, hi)) in zip(unit, ranges.items())])
