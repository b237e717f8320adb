"""A fitted model on perturbed observations, condition by condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import metric_row
from ..operators.perturb import (
    jitter_visit_timing, remove_measurements, remove_visits, truncate_to_recent_visits,
)
from ..spec import Condition, VisitSpec
from .training import Artifact


def perturb(obs: DataFrame, spec: VisitSpec, condition: Condition, *, seed: int = 42) -> DataFrame:
    """Apply one named perturbation; ``baseline`` changes nothing.  Groups are cohort sized."""
    kind, strength = condition.kind, condition.strength
    if kind == "baseline":
        return obs
    if kind == "remove_measurements":
        return remove_measurements(obs, spec, strength, seed=seed)
    if kind == "remove_visits":
        return remove_visits(obs, spec, strength, seed=seed, bounded=True)
    if kind == "truncate_to_recent_visits":
        return truncate_to_recent_visits(obs, spec, int(strength))
    if kind == "jitter_visit_timing":
        return jitter_visit_timing(obs, spec, int(strength), seed=seed, bounded=True)
    raise ValueError(f"unknown perturbation {kind!r}")


def robustness_sweep(obs: DataFrame, targets: DataFrame, artifact: Artifact,
                     conditions: list[Condition], *, seed: int = 42) -> DataFrame:
    """One metric row per condition.

    The perturbed tables are put under one another with (condition, entity) as the
    entity, so all of them go through one feature and scoring plan.
    """
    spec, e = artifact.spec, artifact.spec.entity
    changed = [
        perturb(obs, spec, c, seed=seed).withColumn(
            e, F.struct(F.lit(c.kind).alias("kind"), F.lit(c.strength).cast("double").alias("strength"),
                        F.col(e).alias("of"))) for c in conditions]
    scored = artifact.score(reduce(DataFrame.unionByName, changed), bounded=True).select(
        f"{e}.kind", f"{e}.strength", F.col(f"{e}.of").alias(e), "p")
    label = targets.select(e, F.col(spec.target).cast("double").alias("label"))
    return metric_row(scored.join(label, e), artifact.threshold, ["kind", "strength"], y="label")
