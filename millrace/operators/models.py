"""Models on pyspark.ml: features in, chronological training, prediction with probabilities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators.reshape import check_target, sequences
from millrace.operators.runs import backtest_predictions

KINDS = {
    "random_forest": lambda seed: RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=50, maxDepth=6, seed=seed),
    "boosted_trees": lambda seed: GBTClassifier(featuresCol="features", labelCol="label", maxIter=30, maxDepth=4, seed=seed),
}


def train(df: DataFrame, features: list[str], target: str, kind: str = "random_forest", scale: bool = False, seed: int = 7) -> PipelineModel:
    """A fitted pipeline over rows whose features and target aren't null."""
    check_target(target, features)
    x = df.dropna(subset=[*features, target]).withColumn("label", F.col(target).cast("double"))
    stages = [VectorAssembler(inputCols=features, outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, KINDS[kind](seed)]).fit(x)


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds p (probability of 1) and prediction to the rows whose features aren't null."""
    x = model.transform(df.dropna(subset=features))
    return x.withColumn("p", vector_to_array("probability")[1]).drop("features", "raw", "rawPrediction", "probability")


def evaluate(model: PipelineModel, df: DataFrame, features: list[str], target: str, bars: bool = False, periods: int = 252, **options) -> tuple[DataFrame, DataFrame | None]:
    """(statistics, financial metrics): the second is None, and has to be asked for, without bars."""
    x = predict(model, df.dropna(subset=[target]), features)
    stats = M.classification(x, target, "prediction", "p")
    return stats, backtest_predictions(x, "p", periods, **options) if bars else None


def save_model(model: PipelineModel, path: str) -> str:
    """Writes a model and returns the SHA-256 of its description, which ``load_model`` can demand."""
    model.write().overwrite().save(path)
    return fingerprint(model)


def load_model(path: str, expect: str | None = None) -> PipelineModel:
    model = PipelineModel.load(path)
    if expect is not None and fingerprint(model) != expect:
        raise ValueError(f"the model in {path} is not the one expected")
    return model


def fingerprint(model: PipelineModel) -> str:
    """SHA-256 of the stages' kinds and learned content: trees as text, scalers as numbers."""
    parts = []
    for s in model.stages:
        parts.append(type(s).__name__)
        parts.append(s.toDebugString.split("\n", 1)[1] if hasattr(s, "toDebugString") else repr((s.mean.toArray().tolist(), s.std.toArray().tolist())) if hasattr(s, "std") else "")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """Per symbol, and mergeable over increments: n, sum and sum of squares of each feature (nulls out)."""
    return df.groupBy("symbol").agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in features for n, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))])


def merged_scaler(parts: list[DataFrame], features: list[str]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("symbol").agg(*[F.sum(f"{c}_{n}").alias(f"{c}_{n}") for c in features for n in "nsq"])


def scaled(df: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """Features less their symbol's mean, over its population deviation (1 where that is 0)."""
    x = df.join(fitted, "symbol", "left")
    for c in features:
        mean = F.col(f"{c}_s") / F.col(f"{c}_n")
        sd = F.sqrt(F.greatest(F.col(f"{c}_q") / F.col(f"{c}_n") - mean * mean, F.lit(0.0)))
        x = x.withColumn(c, (F.col(c) - mean) / F.when(sd > 0, sd).otherwise(1.0))
    return x.select(df.columns)


def shuffled_windows(df: DataFrame, features: list[str], length: int, stride: int = 1, target: str | None = None, seed: int = 7, fitted: DataFrame | None = None, worker: int = 0, workers: int = 1) -> Iterator[Row]:
    """Sequence windows of a worker's share of the symbols in a seeded random order, partition by
    partition: the driver holds one partition at a time."""
    x = df if fitted is None else scaled(df, fitted, features)
    x = x.where(F.pmod(F.xxhash64("symbol"), F.lit(workers)) == worker)
    x = sequences(x, features, length, stride, target)
    order = F.xxhash64(F.lit(seed), "symbol", "ts")
    return x.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").drop("_o").toLocalIterator()


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
