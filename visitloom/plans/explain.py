"""Explanations: global importance, per-entity contributions, temporal occlusion.

Inputs are ``entity, features`` (a vector per entity) or padded sequences.  Every
method scores exploded rows in one distributed pass; the method column says what
was computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sort_cuts, uniform
from ..operators.metrics import auroc
from ..operators.ordered import positions
from ..sources.session import written
from .models import FittedModel

def permutation_importance(model: FittedModel, data: DataFrame, entity: str, names: list[str], *,
                           repeats: int = 5, seed: int = 42, **kw) -> DataFrame:
    """``feature, importance``: mean fall of AUROC when a feature is shuffled between entities.

    Entities stand in a ring in a seeded random order.  A repeat turns the ring by a seeded random distance, so every
    entity meets another one's whole vector in one equi-join on the position: entities x repeats rows are shuffled,
    whatever the number of features.  Each feature is then swapped in the joined row.
    ``data`` is ``entity, features, label``.
    """
    data = written(data.select(entity, "features", "label"), "explained")     # counted, ranked and scored
    rows = data.withColumn("_u", uniform(seed, F.lit("order"), entity))
    placed = written(positions(rows, [], [F.col("_u"), F.col(entity)], [F.col("_u"), *sort_cuts(rows, [entity])],
                               "_i", total="_n", **kw).select("_i", "_n", "label", vector_to_array("features").alias("_x")),
                     "ring")     # one side of the join and the other
    turn = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("r")
    u = uniform(seed, F.lit("shift"), F.col("r").cast("string"))
    shift = F.lit(1) + F.floor(u * F.greatest(F.col("_n") - 1, F.lit(1)))
    donors = placed.select("_i", "_n", F.col("_x").alias("_y"), turn).select(
        "r", "_y", ((F.col("_i") + shift) % F.col("_n")).alias("_i"))
    met = placed.select("_i", "_x", "label").join(donors, "_i")
    each = met.select("r", "label", "_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j"))
    changed = each.select("j", "r", "label", array_to_vector(F.transform(
        "_x", lambda x, k: F.when(k == F.col("j"), F.get("_y", k)).otherwise(x))).alias("features"))
    after = auroc(model.predict_proba(changed), ["j", "r"], y="label", **kw)
    base = auroc(model.predict_proba(data), y="label", **kw).select(
        F.coalesce("auroc", F.lit(0.5)).alias("_base"), F.lit(1).alias("_k"))
    label = F.array(*[F.lit(n) for n in names])
    drops = after.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k")   # one row
    return drops.groupBy(F.get(label, F.col("j")).alias("feature")).agg(
        F.coalesce(F.avg(F.col("_base") - F.col("auroc")), F.lit(0.0)).alias("importance"))


def global_ranking(importance: DataFrame, readable: DataFrame, *, top: int = 20,
                   method: str = "permutation") -> DataFrame:
    """``rank, feature, readable_name, importance, method`` of the top features (a row per feature comes in).

    ``readable`` is ``feature, readable_name``.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("importance").desc(), "feature")
    ranked = importance.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(readable, "feature", "left").select(
        "rank", "feature", F.coalesce("readable_name", "feature").alias("readable_name"), "importance",
        F.lit(method).alias("method")).orderBy("rank")   # a row per feature


def explanation_records(contributions: DataFrame, scored: DataFrame, readable: DataFrame, entity: str,
                        threshold: float = 0.5) -> DataFrame:
    """Contributions with each entity's probability, class and threshold, and the features' readable names.

    ``scored`` is ``entity, p``.  Entities without a score keep their rows, with NULLs.
    """
    known = scored.select(entity, F.col("p").alias("probability"), (F.col("p") >= threshold).cast("int").alias(
        "predicted_class"))
    return contributions.join(known, entity, "left").join(readable, "feature", "left").select(
        entity, "probability", "predicted_class", F.lit(float(threshold)).alias("threshold"), "rank", "feature",
        F.coalesce("readable_name", "feature").alias("readable_name"), "value", "contribution", "direction", "method")


def _ranked(contributions: DataFrame, entity: str, top: int, method: str) -> DataFrame:
    """Ranks by size within an entity; keeps the ``top`` positive and the ``top`` others."""
    # One row per feature and entity, so a window group is as long as the feature list.
    size = F.abs("contribution").desc()
    side = F.col("contribution") > 0
    w = Window.partitionBy(entity).orderBy(size, "feature")
    v = Window.partitionBy(entity, "_side").orderBy(size, "feature")
    return (contributions.withColumn("_side", side).withColumn("rank", F.row_number().over(w))
            .withColumn("_place", F.row_number().over(v)).filter(F.col("_place") <= top)
            .select(entity, "rank", "feature", "value", "contribution",
                    F.when(side, "increases_risk").otherwise("decreases_risk").alias("direction"),
                    F.lit(method).alias("method")))


def linear_contributions(model: FittedModel, data: DataFrame, entity: str, names: list[str], *,
                         top: int = 10) -> DataFrame:
    """Exact additive terms ``coefficient * value`` of a logistic regression."""
    coefs = [float(c) for c in model.model.coefficients.toArray()]
    label, weight = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(c) for c in coefs])
    cells = data.select(entity, F.posexplode(vector_to_array("features")).alias("j", "value"))
    return _ranked(cells.select(
        entity, F.get(label, F.col("j")).alias("feature"), "value",
        (F.get(weight, F.col("j")) * F.col("value")).alias("contribution")), entity, top, "linear")


def ablation_contributions(model: FittedModel, data: DataFrame, entity: str, names: list[str], *,
                           top: int = 10) -> DataFrame:
    """Change of the probability when one processed feature is set to its training centre, 0."""
    label = F.array(*[F.lit(n) for n in names])
    base = model.predict_proba(data.select(entity, "features")).select(
        entity, F.col("p").alias("_base"), vector_to_array("features").alias("_x"))
    cells = base.select(entity, "_base", "_x", F.posexplode("_x").alias("j", "value"))
    without = cells.withColumn("features", array_to_vector(F.transform(
        "_x", lambda x, k: F.when(k == F.col("j"), 0.0).otherwise(x))))
    scored = model.predict_proba(without)
    return _ranked(scored.select(
        entity, F.get(label, F.col("j")).alias("feature"), "value",
        (F.col("_base") - F.col("p")).alias("contribution")), entity, top, "ablation")


def temporal_occlusion(packed: DataFrame, entity: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Influence of each step: the probability falls by this much without it.

    ``packed`` is ``entity, X, mask``; ``score`` adds ``p`` to such a table.  A step is
    blanked in place, features and mask.  Padding has rank 0; the last remaining step
    has no influence.
    """
    base = score(packed.select(entity, "X", "mask")).select(entity, "X", "mask", F.col("p").alias("baseline"))
    steps = base.select("*", F.posexplode("mask").alias("step", "_real"))
    blank: Column = F.transform("X", lambda v, i: F.when(
        i == F.col("step"), F.transform(v, lambda x: F.lit(0.0))).otherwise(v))
    mask = F.transform("mask", lambda m, i: F.when(i == F.col("step"), 0).otherwise(m))
    hidden = steps.withColumns({"X": blank, "mask": mask})
    scored = score(hidden)
    left = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    occluded = F.when(left == 0, F.col("baseline")).otherwise(F.col("p"))
    out = scored.select(entity, "step", F.col("_real").alias("is_real"), "baseline",
                        occluded.alias("occluded"), (F.col("baseline") - occluded).alias("influence"))
    w = Window.partitionBy(entity, "is_real").orderBy(F.abs("influence").desc(), "step")   # as long as a sequence
    return out.withColumn("rank", F.when(F.col("is_real") == 1, F.row_number().over(w)).otherwise(0))
