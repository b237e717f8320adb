"""Classifiers behind one contract: fit on ``features, label``, add ``p`` = P(class 1)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import quoted
from ..sources.session import written

WIDE, SEQUENCE = "wide", "sequence"
MAX_DEPTH = 30          # of Spark ML trees
FIT_PARTITIONS = 8      # at least; a task of a fit holds about ROWS_PER_FIT_TASK rows
ROWS_PER_FIT_TASK = 100_000
REPRESENTATION = {
    "logistic_regression": WIDE, "random_forest": WIDE, "gradient_boosting": WIDE,
    "gradient_boosting_leafwise": WIDE, "sequence_network": SEQUENCE,
}


def assemble(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and a dense ``features`` vector of the named columns."""
    return df.select(*keep, array_to_vector(F.array(*[quoted(n).cast("double") for n in names])).alias("features"))


def class_counts(df: DataFrame, label: str = "label") -> dict[float, int]:
    """Rows per class (two rows)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def balanced_weights(df: DataFrame, label: str = "label", counts: dict | None = None) -> DataFrame:
    """Adds ``weight`` = n / (classes * n_class)."""
    counts = counts or class_counts(df, label)
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def make_estimator(family: str, params: dict[str, Any], n_rows: int, n_features: int):
    """A Spark ML estimator; parameter names follow the usual ones of each family."""
    p = dict(params)
    seed = p.pop("seed", 42)
    common = {"featuresCol": "features", "labelCol": "label"}
    if p.pop("class_weight", None) == "balanced":
        common["weightCol"] = "weight"
    if family == "logistic_regression":
        # The penalty 1/(C n) makes the mean loss plus ridge equal the usual C-weighted form.
        return LogisticRegression(
            regParam=1.0 / (p.get("C", 1.0) * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
            maxIter=p.get("max_iter", 100), **common)
    if family == "random_forest":
        return RandomForestClassifier(
            numTrees=p.get("n_estimators", 100), maxDepth=_depth(p.get("max_depth") or MAX_DEPTH),
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=str(p.get("max_features", "sqrt")), seed=seed, **common)
    if family in ("gradient_boosting", "gradient_boosting_leafwise"):
        depth = p.get("max_depth", 5)
        if family == "gradient_boosting_leafwise":   # depth that gives the wanted number of leaves
            leaves = math.ceil(math.log2(max(p.get("num_leaves", 31), 2)))
            depth = leaves if depth < 1 else min(depth, leaves)
        return GBTClassifier(
            maxIter=p.get("n_estimators", 50), maxDepth=_depth(depth), stepSize=p.get("learning_rate", 0.1),
            subsamplingRate=p.get("subsample", 1.0), featureSubsetStrategy=str(p.get("colsample", "all")),
            minInstancesPerNode=p.get("min_child_samples", 1), seed=seed, **common)
    if family == "sequence_network":
        common.pop("weightCol", None)
        return MultilayerPerceptronClassifier(
            layers=[n_features, *p.get("hidden", [32]), 2], maxIter=p.get("epochs", 50), seed=seed, **common)
    raise ValueError(f"unknown model family {family!r}")


@dataclass
class FittedModel:
    """A fitted classifier, its family and its parameters."""

    family: str
    model: Any
    params: dict[str, Any] = field(default_factory=dict)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", (F.col("p") >= threshold).cast("int"))

    def save(self, path: str) -> None:
        PipelineModel([self.model]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, family: str, params: dict[str, Any] | None = None) -> "FittedModel":
        return cls(family, PipelineModel.load(path).stages[0], params or {})


def _depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep, not {depth}")
    return depth


def fit_partitions(n_rows: int) -> int:
    """Tasks of a fit over so many rows."""
    return max(FIT_PARTITIONS, math.ceil(n_rows / ROWS_PER_FIT_TASK))


def fit(family: str, params: dict[str, Any], train: DataFrame, partitions: int | None = None) -> FittedModel:
    """Fit one family on ``features, label``; other columns, such as the entity, are the identity of a row.

    Rows are dealt by the hash of their content and identity, to as many tasks as the table asks for unless
    ``partitions`` says otherwise, and sorted there.  So rows of equal content are spread as far as they have an
    identity, and one seed gives one model whatever the partitioning of ``train``.
    """
    if not train.is_cached:     # counted first, then dealt; made once
        train = written(train, "fit-rows")
    counts = class_counts(train)
    if not counts:
        raise ValueError("no training rows")
    n = sum(counts.values())
    identity = [quoted(c) for c in sorted(train.columns) if c not in ("features", "label", "weight")]
    place = F.xxhash64(vector_to_array("features"), "label", *identity)
    train = (train.select("features", "label", place.alias("_h")).repartition(partitions or fit_partitions(n), "_h")
             .sortWithinPartitions("_h").drop("_h").persist())   # iterative fits read it many times
    try:
        width = train.select("features").head()[0].size
        est = make_estimator(family, params, n, width)
        ready = balanced_weights(train, counts=counts) if params.get("class_weight") == "balanced" else train
        return FittedModel(family, est.fit(ready), dict(params))
    finally:
        train.unpersist()
