"""Model search: seeded random trials ranked by validation AUROC."""

from __future__ import annotations

import json
import logging
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import metric_row
from ..spec import DataError
from .models import REPRESENTATION, FittedModel, fit

log = logging.getLogger(__name__)

BOARD = (
    "trial int, model string, representation string, state string, validation_auroc double, "
    "validation_auprc double, validation_f1 double, validation_accuracy double, validation_precision double, "
    "validation_recall double, validation_specificity double, validation_brier double, "
    "train_seconds double, inference_seconds_per_entity double, hyperparameters string")

# Ranges searched per family (low, high, scale) or lists of choices.
SPACES: dict[str, dict[str, Any]] = {
    "logistic_regression": {"C": (1e-4, 100.0, "log"), "class_weight": [None, "balanced"]},
    "random_forest": {
        "n_estimators": (100, 800, "int"), "max_depth": [None, 5, 10, 15, 20, 30],
        "min_samples_leaf": (1, 10, "int"), "max_features": ["sqrt", "log2", 0.3, 0.5, 0.7],
        "class_weight": [None, "balanced"]},
    "gradient_boosting": {
        "n_estimators": (100, 800, "int"), "max_depth": (3, 12, "int"), "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "linear"), "colsample": (0.6, 1.0, "linear"), "min_child_samples": (1, 10, "int")},
    "gradient_boosting_leafwise": {
        "n_estimators": (100, 800, "int"), "learning_rate": (0.01, 0.3, "log"), "num_leaves": (8, 128, "int"),
        "max_depth": (-1, 20, "int"), "min_child_samples": (5, 100, "int"),
        "subsample": (0.6, 1.0, "linear"), "colsample": (0.6, 1.0, "linear")},
    "sequence_network": {"hidden": [[32], [64], [128], [256], [64, 32], [128, 64]], "epochs": [20, 50, 100]},
}


@dataclass(frozen=True)
class Trial:
    number: int
    family: str
    params: tuple[tuple[str, Any], ...]

    @property
    def representation(self) -> str:
        return REPRESENTATION[self.family]


def draw_trials(n: int, families: list[str], seed: int = 42,
                spaces: dict[str, dict[str, Any]] = SPACES) -> list[Trial]:
    """``n`` trials with seeded random families and parameters."""
    rng = random.Random(seed)
    trials = []
    for i in range(n):
        family = rng.choice(families)
        params = {}
        for name, space in spaces[family].items():
            if isinstance(space, list):
                params[name] = rng.choice(space)
            else:
                low, high, scale = space
                if scale == "int":
                    params[name] = rng.randint(low, high)
                elif scale == "log":
                    params[name] = low * (high / low) ** rng.random()
                else:
                    params[name] = rng.uniform(low, high)
        trials.append(Trial(i, family, tuple({**params, "seed": seed}.items())))
    return trials


def _without_metrics(trial: Trial, state: str, reason: str) -> tuple:
    known = {**dict(trial.params), **({"error": reason[:500]} if reason else {})}
    return (trial.number, trial.family, trial.representation, state, *[None] * 10, json.dumps(known))


@dataclass
class SearchResult:
    leaderboard: DataFrame
    best: Trial
    best_metrics: dict[str, float | None]
    models: dict[int, FittedModel]


def run_search(spark: SparkSession, trials: list[Trial], data: dict[str, tuple[DataFrame, DataFrame]], *,
               threshold: float = 0.5, parallelism: int = 2) -> SearchResult:
    """Fit every trial on train and score it on validation; test rows are not an argument.

    ``data`` maps a representation to ``(train, validation)`` with ``features, label``.
    A trial that Spark or its parameters refuse is on the board as ``failed``, one whose AUROC is undefined as
    ``undefined``, both without metrics; if the session itself is lost, the error is raised.
    ``parallelism`` trials run as concurrent Spark jobs.
    """
    def attempt(trial: Trial):
        train, val = data[trial.representation]
        start = time.perf_counter()
        try:
            model = fit(trial.family, dict(trial.params), train)
        except (ValueError, PySparkException) as exc:
            if spark.sparkContext._jsc.sc().isStopped():
                raise
            log.warning("trial %d (%s) failed: %s", trial.number, trial.family, exc)
            return trial, None, None, _without_metrics(trial, "failed", str(exc))
        fitted = time.perf_counter()
        m = metric_row(model.predict_proba(val), threshold, y="label").first().asDict()   # one row
        done = time.perf_counter()
        if m["auroc"] is None:
            log.warning("trial %d has no defined validation AUROC", trial.number)
            return trial, None, None, _without_metrics(trial, "undefined", "")
        row = (trial.number, trial.family, trial.representation, "complete",
               *[m[k] for k in ("auroc", "auprc", "f1", "accuracy", "precision", "recall", "specificity", "brier")],
               round(fitted - start, 4), round((done - fitted) / max(m["n_samples"], 1), 6),
               json.dumps(dict(trial.params)))
        return trial, model, m, row

    usable = [t for t in trials if t.representation in data]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        tried = list(pool.map(attempt, usable))
    results = [r for r in tried if r[1] is not None]
    if not results:
        raise DataError("no trial completed")
    best = max(results, key=lambda r: (r[2]["auroc"], -r[0].number))
    board = spark.createDataFrame([r[3] for r in tried], BOARD)
    return SearchResult(board.orderBy(F.col("validation_auroc").desc_nulls_last(), "trial"), best[0], best[2],
                        {r[0].number: r[1] for r in results})
