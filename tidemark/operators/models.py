"""Classifiers, scoring, the model registry and evaluation across datasets."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import col
from tidemark.operators import trees
from tidemark.operators.active import confidence
from tidemark.operators.profile import common_features
from tidemark.workspace import ship_package

# The settings of the two model families.
GBT_DEFAULTS = {"maxIter": 200, "maxDepth": 8, "stepSize": 0.1, "maxLeaves": 63, "minInstancesPerNode": 20}
FOREST_DEFAULTS = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2, "minInstancesToSplit": 5, "maxBins": 32}
_NAMES = {
    "maxIter": "trees", "numTrees": "trees", "maxDepth": "depth", "stepSize": "rate", "maxLeaves": "leaves", "maxBins": "bins",
    "minInstancesPerNode": "min_rows", "minInstancesToSplit": "min_split",
}


def settings(algorithm: str = "gbt", balanced: bool = True, seed: int = 42, **params) -> trees.Settings:
    """The settings of a model family with some of its parameters replaced."""
    if algorithm not in ("gbt", "rf"):
        raise ValueError(f"unknown algorithm {algorithm!r}; known: gbt, rf")
    chosen = {**(GBT_DEFAULTS if algorithm == "gbt" else {**FOREST_DEFAULTS, "maxLeaves": 0}), **params}
    return trees.Settings(algorithm=algorithm, balanced=balanced, seed=seed, **{_NAMES[k]: v for k, v in chosen.items()})


@dataclass
class Classifier:
    """A fitted model with the feature list it was fitted on."""

    model: trees.Trees

    @property
    def features(self) -> list[str]:
        return self.model.features

    @property
    def labels(self) -> list[str]:
        return self.model.labels

    @property
    def metadata(self) -> dict:
        return self.model.metadata

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``, ``probabilities`` (array, in label order) and ``confidence``.

        A missing column, and a missing, NaN or infinite value, counts as 0.
        """
        out = df.withColumn("probabilities", scores(df, self.model))
        best = F.array_position("probabilities", F.array_max("probabilities"))
        names = F.array(*[F.lit(x) for x in self.labels])
        return out.withColumn("y_pred", F.get(names, best.cast("int") - 1)).withColumn("confidence", confidence("probabilities"))

    def importances(self, kind: str = "gain") -> list[tuple[str, float]]:
        return list(zip(self.features, self.model.importances(kind).tolist()))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.model.to_bytes(),)], "model binary").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        return Classifier(trees.Trees.from_bytes(bytes(spark.read.parquet(path).first()["model"])))


def scores(df: DataFrame, model: trees.Trees) -> Column:
    """Probabilities of the rows of ``df`` as a column; batches of Arrow columns meet all trees at once."""
    spark = df.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # its size is set by the settings, not by the rows
    zeros = {f: F.lit(0.0) for f in model.features}
    inputs = [col(f).cast("double") if f in df.columns else zeros[f] for f in model.features]

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one feature comes bare
            yield pd.Series(list(held.value.probabilities([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])))

    return probabilities(*inputs)


def train(df: DataFrame, features: list[str], label: str, algorithm: str = "gbt", balanced: bool = True, seed: int = 42, **params) -> Classifier:
    """Fit gradient-boosted trees or a random forest, for any number of labels, on the given columns."""
    one = df.withColumn("_one", F.lit("model"))
    return train_many(one, "_one", features, label, settings(algorithm, balanced, seed, **params))["model"]


def train_many(df: DataFrame, model: str, features: list[str], label: str, how: trees.Settings | dict[str, trees.Settings]) -> dict[str, Classifier]:
    """One model per value of the column ``model``, grown side by side."""
    return {name: Classifier(fitted) for name, fitted in trees.fit_many(df, model, features, label, how).items()}


def importance_table(spark: SparkSession, model: Classifier) -> DataFrame:
    return spark.createDataFrame(model.importances(), "feature string, importance double")


def importance_shift(spark: SparkSession, earlier: Classifier, later: Classifier) -> DataFrame:
    """Importances of two models side by side, matched by feature name."""
    a = importance_table(spark, earlier).withColumnRenamed("importance", "importance_earlier")
    b = importance_table(spark, later).withColumnRenamed("importance", "importance_later")
    both = a.join(b, "feature", "full").fillna(0.0)
    return both.withColumn("importance_shift", F.abs(F.col("importance_later") - F.col("importance_earlier")))


def scoring_summary(scored: DataFrame, prediction: str, conf: str) -> DataFrame:
    """Rows, percentage and mean confidence per predicted class."""
    counts = scored.groupBy(col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_confidence")
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("prediction", "n", F.round(F.col("n") * 100 / total, 2).alias("pct"), "mean_confidence")


# --- registry: an append-only table of fitted models -------------------------------------


def register_model(spark: SparkSession, root: str, model: Classifier, model_id: str, algorithm: str, metrics: dict[str, float]) -> str:
    """Save the model and append its record, which is written last.

    The record keeps what the model was fitted on: rows, features, labels, parameters, seconds.
    """
    path = f"{root}/models/{model_id}"
    model.save(spark, path)
    m = model.metadata
    record = [(
        model_id, algorithm, path, time.time_ns(), metrics, m["training_samples"], m["n_features"], model.features, m["classes"],
        m["random_seed"], json.dumps(m["params"], sort_keys=True), m["training_time_s"],
    )]
    schema = (
        "model_id string, algorithm string, path string, seq long, metrics map<string,double>, training_samples long, n_features int, "
        "features array<string>, classes array<string>, random_seed long, params string, training_time_s double"
    )
    spark.createDataFrame(record, schema).write.mode("append").parquet(f"{root}/registry")
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/registry")


def model_by_id(records: DataFrame, model_id: str) -> DataFrame:
    return records.filter(F.col("model_id") == model_id)


def latest_models(records: DataFrame, seq: str, by: list[str], columns: list[str]) -> DataFrame:
    """The newest record per group in one partial aggregation, with the number registered."""
    return records.groupBy(*by).agg(
        *[F.max_by(c, seq).alias(c) for c in columns], F.max(seq).alias(seq), F.count(F.lit(1)).alias("n_registered")
    )


# --- across datasets ----------------------------------------------------------------------


def cross_dataset(a: DataFrame, b: DataFrame, label: str = "Label", algorithm: str = "gbt", combined: DataFrame | None = None, **params) -> DataFrame:
    """Score ``b`` with a model of ``a`` (or of ``a`` and ``combined``) on their common features."""
    features = common_features(a, b)
    side = lambda df: df.select(*[col(f).cast("double").alias(f) for f in features], col(label))
    rows = side(a) if combined is None else side(a).unionByName(side(combined))
    return train(rows, features, label, algorithm, **params).predict(side(b))
