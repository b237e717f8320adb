"""Padded visit sequences with one-hot categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import missing_to_null, require_columns, row_cuts, sort_cuts
from ..spec import MISSING_LABEL, UNKNOWN_LABEL, DataError, VisitSpec
from .guards import refuse_leakage
from .ordered import GROUP_LIMIT, first_rows, positions

MAX_SLOTS = 20_000   # labels that the driver takes; a larger vocabulary stays a table
Vocabulary = dict[str, list[str]] | DataFrame


def vocabulary(train: DataFrame, spec: VisitSpec) -> DataFrame:
    """``feature, slot, label``: missing at 0, unknown at 1, then the sorted labels."""
    present = [c for c in spec.categorical if c in train.columns]
    spark = train.sparkSession
    special = spark.createDataFrame(
        [(c, i, label) for c in spec.categorical for i, label in enumerate((MISSING_LABEL, UNKNOWN_LABEL))],
        "feature string, slot int, label string")
    if not present:
        return special
    values = (train.select(*[missing_to_null(F.col(c)).alias(c) for c in present])
              .unpivot([], present, "feature", "label").filter(F.col("label").isNotNull()).distinct())
    placed = positions(values, ["feature"], [F.col("label")], sort_cuts(values, ["label"]), "slot")
    return special.unionByName(placed.select("feature", (F.col("slot") + 2).cast("int").alias("slot"), "label"))


def collect_vocabulary(vocab: DataFrame) -> dict[str, list[str]]:
    """The vocabulary on the driver, after a check of its size."""
    rows = vocab.orderBy("feature", "slot").limit(MAX_SLOTS + 1).collect()
    if len(rows) > MAX_SLOTS:
        raise DataError(f"one-hot layout would need more than {MAX_SLOTS} slots")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["feature"], []).append(r["label"])
    return out


def slot_table(spark: SparkSession, vocab: Vocabulary) -> tuple[DataFrame, dict[str, int]]:
    """``feature, slot, label`` and the number of slots of every feature (a row per feature reaches the driver)."""
    if isinstance(vocab, dict):
        rows = [(c, i, label) for c, labels in vocab.items() for i, label in enumerate(labels)]
        return (spark.createDataFrame(rows, "feature string, slot int, label string"),
                {c: len(labels) for c, labels in vocab.items()})
    counts = vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
    return vocab, {r["feature"]: r["n"] for r in counts}


def layout(obs: DataFrame, spec: VisitSpec, vocab: dict[str, list[str]]) -> list[str]:
    """Feature names of one visit vector: numeric columns present, then ``cat__label`` blocks."""
    return [c for c in spec.numeric if c in obs.columns] + [
        f"{c}__{label}" for c in spec.categorical if c in obs.columns for label in vocab[c]]


def recent_steps(obs: DataFrame, spec: VisitSpec, max_len: int, **kw) -> DataFrame:
    """The last ``max_len`` visits with ``step`` 0.. in time order and ``length``."""
    e = spec.entity
    newest = first_rows(obs, [e], [F.col(c).desc() for c in spec.order], max_len,
                        cuts=row_cuts(obs, spec.order, newest=True), **kw)
    return positions(newest.drop("_rank"), [e], [F.col(c) for c in spec.order],
                     row_cuts(newest, spec.order), "step", total="length",
                     bounded=max_len <= GROUP_LIMIT, **kw)


def visit_vectors(obs: DataFrame, spec: VisitSpec, vocab: Vocabulary, max_len: int = 4) -> DataFrame:
    """``entity, step, length, vector`` for every real step; numeric NULLs stay NULL.

    The slot of a label comes from a join with the vocabulary, so the plan does not grow with the labels.
    """
    refuse_leakage(obs, spec, "visit_vectors")
    require_columns(obs, [spec.entity, *spec.order], "visit_vectors")
    table, sizes = slot_table(obs.sparkSession, vocab)
    parts = [F.array(*[F.col(c).cast("double") for c in spec.numeric if c in obs.columns]).cast("array<double>")]
    steps = recent_steps(obs, spec, max_len)
    for c in spec.categorical:
        if c not in obs.columns:
            continue
        labels = table.filter((F.col("feature") == c) & (F.col("slot") >= 2)).select(
            F.col("label").alias(f"_label_{c}"), F.col("slot").alias(f"_slot_{c}"))
        steps = steps.withColumn(f"_label_{c}", missing_to_null(F.col(c))).join(labels, f"_label_{c}", "left")
        slot = F.when(F.col(f"_label_{c}").isNull(), 0).otherwise(F.coalesce(f"_slot_{c}", F.lit(1)))
        zero = F.lit(0.0)
        parts.append(F.concat(F.array_repeat(zero, slot), F.array(F.lit(1.0)),
                              F.array_repeat(zero, F.lit(sizes[c] - 1) - slot)))
    return steps.select(spec.entity, F.col("step").cast("int").alias("step"),
                        F.col("length").cast("int").alias("length"), F.concat(*parts).alias("vector"))


def pack(vectors: DataFrame, spec: VisitSpec, width: int, max_len: int = 4) -> DataFrame:
    """``X`` (steps x features, zero padded), ``mask`` and ``length`` per entity."""
    steps = F.array_sort(F.collect_list(F.struct("step", "vector")))   # at most max_len items
    packed = vectors.groupBy(spec.entity).agg(F.max("length").alias("length"), steps.alias("_s"))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(max_len) - F.col("length"))
    return packed.select(
        spec.entity, F.concat(F.col("_s.vector"), pad).alias("X"),
        F.concat(F.array_repeat(F.lit(1), F.col("length")),
                 F.array_repeat(F.lit(0), F.lit(max_len) - F.col("length"))).alias("mask"), "length")


def sequences(obs: DataFrame, spec: VisitSpec, vocab: Vocabulary, max_len: int = 4) -> DataFrame:
    """Padded sequences of the most recent visits, left aligned in time order."""
    _, sizes = slot_table(obs.sparkSession, vocab)
    width = sum(c in obs.columns for c in spec.numeric) + sum(
        sizes[c] for c in spec.categorical if c in obs.columns)
    return pack(visit_vectors(obs, spec, vocab, max_len), spec, width, max_len)


def unpack(packed: DataFrame, spec: VisitSpec, names: list[str]) -> DataFrame:
    """Long form ``entity, step, is_real, feature, value`` of packed sequences."""
    steps = packed.select(spec.entity, "mask", F.posexplode("X").alias("step", "_v"))
    cells = steps.select(
        spec.entity, "step", F.get("mask", F.col("step")).alias("is_real"),
        F.posexplode("_v").alias("_j", "value"))
    name = F.array(*[F.lit(n) for n in names])
    return cells.select(spec.entity, "step", "is_real", F.get(name, F.col("_j")).alias("feature"), "value")


def length_statistics(packed: DataFrame) -> DataFrame:
    """One row: entities, min, max, median and mean sequence length."""
    return packed.groupBy().agg(
        F.count(F.lit(1)).alias("n_entities"), F.min("length").alias("length_min"),
        F.max("length").alias("length_max"),
        F.expr("percentile(length, 0.5)").alias("length_median"),   # at most max_len distinct values
        F.avg("length").alias("length_mean"))
