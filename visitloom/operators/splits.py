"""Splits of entities (never of rows) into train, validation and test.

Assignment is a rank by a seeded hash inside each class.  The per-class sizes
come from a table with one row per class.  Few classes are shared out as constants, which costs one
ranking and a broadcast of some rows; many are ranked by their remainders over ranges, and joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sort_cuts, uniform
from ..sources.session import written
from ..spec import DataError, SplitSizes, VisitSpec
from .ordered import positions

TRAIN, VALIDATION, TEST = "train", "validation", "test"
MAX_CLASSES = 1_000     # classes that are planted as constants; more are a table


def candidates(obs: DataFrame, targets: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entities that have both observation rows and a target."""
    e = spec.entity
    return targets.select(e, spec.target).join(obs.select(e).distinct(), e, "left_semi")


def _enough(labeled: DataFrame, least: int) -> None:
    found = labeled.limit(least).count()
    if found < least:
        raise DataError(f"need at least {least} entities for this split, got {found}")


def _allocate(classes: DataFrame, size: Column, total: Column, share: str, name: str) -> DataFrame:
    """Largest-remainder shares of ``size`` over the classes (one row per class)."""
    every = Window.partitionBy("_one")
    quota = classes.withColumn("_q", F.col(share) * size / total)
    quota = quota.withColumn("_base", F.floor("_q").cast("long"))
    left = size - F.sum("_base").over(every)
    rank = F.row_number().over(every.orderBy((F.col("_q") - F.col("_base")).desc(), F.col("_class")))
    return (quota.withColumn("_left", left).withColumn("_r", rank)
            .withColumn(name, F.col("_base") + (F.col("_r") <= F.col("_left")).cast("long"))
            .drop("_q", "_base", "_left", "_r"))


def _counted(data: DataFrame, target: str) -> tuple[DataFrame, bool]:
    """``_class, _n`` per class, and whether the classes are few (then constants, else a stored table)."""
    counts = data.groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.limit(MAX_CLASSES + 1).collect()
    if len(rows) <= MAX_CLASSES:
        return data.sparkSession.createDataFrame(rows, counts.schema), True
    return written(counts, "classes"), False


def _ranked_allocation(classes: DataFrame, size: int, total: int, share: str, name: str, **kw) -> DataFrame:
    """The same shares as :func:`_allocate` for any number of classes: remainders are ranked over ranges."""
    if not total:
        return classes.withColumn(name, F.lit(0).cast("long"))
    quota = classes.withColumn("_q", F.col(share) * F.lit(size).cast("long") / F.lit(total).cast("long"))
    quota = written(quota.withColumn("_base", F.floor("_q").cast("long")).withColumn(
        "_part", F.col("_q") - F.col("_base")), "quotas")
    left = size - quota.agg(F.sum("_base")).first()[0]
    placed = positions(quota, [], [F.col("_part").desc(), F.col("_class")],
                       [-F.col("_part"), *sort_cuts(quota, ["_class"])], "_r", **{"at_most": quota, **kw})
    return placed.withColumn(name, F.col("_base") + (F.col("_r") < left).cast("long")).drop("_q", "_base", "_part", "_r")


def class_sizes(labeled: DataFrame, target: str, sizes: SplitSizes, **kw) -> tuple[DataFrame, bool]:
    """Rows per class and how many of them go to test and validation; and whether the classes are few."""
    classes, few = _counted(labeled, target)
    share = sizes.validation / (sizes.train + sizes.validation)
    if not few:
        total = classes.agg(F.sum("_n")).first()[0]
        n_test = math.ceil(total * sizes.test)
        classes = _ranked_allocation(classes, n_test, total, "_n", "_test", **kw)
        classes = classes.withColumn("_rest", F.col("_n") - F.col("_test"))
        rest = total - n_test
        classes = _ranked_allocation(classes, math.ceil(rest * share), rest, "_rest", "_val", **kw)
        return classes.select("_class", "_n", "_test", "_val"), False
    classes = classes.withColumn("_one", F.lit(1))
    every = Window.partitionBy("_one")
    classes = classes.withColumn("_all", F.sum("_n").over(every))
    classes = _allocate(classes, F.ceil(F.col("_all") * F.lit(sizes.test)), F.col("_all"), "_n", "_test")
    classes = classes.withColumn("_rest", F.col("_n") - F.col("_test"))
    classes = classes.withColumn("_restall", F.sum("_rest").over(every))
    classes = _allocate(classes, F.ceil(F.col("_restall") * F.lit(share)), F.col("_restall"), "_rest", "_val")
    return classes.select("_class", "_n", "_test", "_val"), True


def _hinted(classes: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(classes) if few else classes      # few: at most MAX_CLASSES rows


def stratified_split(labeled: DataFrame, spec: VisitSpec, sizes: SplitSizes = SplitSizes(), *,
                     seed: int = 42, stratify: bool = True, **kw) -> DataFrame:
    """``entity, target, split`` with exact sizes, classes shared out in proportion.

    ``stratify=False`` ranks all entities together by the same hash.  Fewer than three entities raise.
    """
    e = spec.entity
    _enough(labeled, 3)
    data = labeled.select(e, spec.target, (F.col(spec.target) if stratify else F.lit(0)).alias("_class"))
    data = data.withColumn("_u", uniform(seed, e))
    classes, few = class_sizes(data, "_class", sizes, **kw)
    small = _hinted(classes.withColumnRenamed("_class", "_c"), few)
    ranked = positions(data, ["_class"], [F.col("_u"), F.col(e)],
                       [F.col("_u"), *sort_cuts(data, [e])], "_i", **kw)
    joined = ranked.join(small, ranked["_class"].eqNullSafe(small["_c"]))
    return joined.select(
        e, spec.target,
        F.when(F.col("_i") < F.col("_test"), TEST)
        .when(F.col("_i") < F.col("_test") + F.col("_val"), VALIDATION).otherwise(TRAIN).alias("split"))


def internal_split(labeled: DataFrame, spec: VisitSpec, fraction: float, *, seed: int = 42,
                   **kw) -> DataFrame:
    """Two-way train/validation split; random when a class has a single entity.  Fewer than two entities raise."""
    e = spec.entity
    _enough(labeled, 2)
    data = labeled.select(e, spec.target).withColumn("_u", uniform(seed, e))
    classes, few = _counted(data, spec.target)
    total = classes.agg(F.sum("_n").alias("all"), F.min("_n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    mixed = total["least"] >= 2 and total["classes"] >= 2
    size = max(1, min(total["all"] - 1, round(total["all"] * fraction)))
    if few:
        classes = _allocate(classes.withColumn("_one", F.lit(1)), F.lit(size).cast("long"), F.lit(total["all"]), "_n", "_val")
    else:
        classes = _ranked_allocation(classes, size, total["all"], "_n", "_val", **kw)
    small = _hinted(classes.select("_class", "_val", F.lit(mixed).alias("_mixed"), F.lit(size).alias("_size")), few)
    data = data.join(small, data[spec.target].eqNullSafe(F.col("_class"))).withColumn(
        "_group", F.when(F.col("_mixed"), F.col("_class").cast("string")).otherwise("all"))
    ranked = positions(data, ["_group"], [F.col("_u"), F.col(e)],
                       [F.col("_u"), *sort_cuts(data, [e])], "_i", **kw)
    cut = F.when(F.col("_mixed"), F.col("_val")).otherwise(F.col("_size"))
    return ranked.select(e, spec.target, F.when(F.col("_i") < cut, VALIDATION).otherwise(TRAIN).alias("split"))


def chronological_split(obs: DataFrame, labeled: DataFrame, spec: VisitSpec,
                        sizes: SplitSizes = SplitSizes(), **kw) -> DataFrame:
    """Entities in order of their first visit: earliest to train, latest to test.  Fewer than three raise."""
    e = spec.entity
    _enough(labeled, 3)
    first = (obs.groupBy(e).agg(F.min(spec.time).alias("_first"))
             .join(labeled.select(e, spec.target), e))
    ranked = positions(first, [], [F.col("_first"), F.col(e)], sort_cuts(first, ["_first", e]),
                       "_i", total="_n", **kw)
    n = F.col("_n")
    n_train = F.greatest(F.lit(1), F.bround(n * F.lit(sizes.train)).cast("long"))
    n_val = F.greatest(F.lit(1), F.bround(n * F.lit(sizes.validation)).cast("long"))
    n_val = F.when(n - n_train - n_val < 1, F.greatest(F.lit(1), n_val - 1)).otherwise(n_val)
    return ranked.select(
        e, spec.target, F.when(F.col("_i") < n_train, TRAIN)
        .when(F.col("_i") < n_train + n_val, VALIDATION).otherwise(TEST).alias("split"))


def check_split(split: DataFrame, spec: VisitSpec, *, both_classes: bool = True) -> None:
    """Raise for fewer than three entities, an empty split, or a split with one class."""
    rows = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(spec.target).alias("classes")).collect()
    total = sum(r["n"] for r in rows)
    if total < 3:
        raise DataError(f"need at least 3 entities for three splits, got {total}")
    missing = {TRAIN, VALIDATION, TEST} - {r["split"] for r in rows}
    if missing:
        raise DataError(f"empty splits {sorted(missing)}")
    single = sorted(r["split"] for r in rows if r["classes"] < 2)
    if both_classes and single:
        raise DataError(f"splits {single} hold one class only")


def with_split(rows: DataFrame, split: DataFrame, spec: VisitSpec) -> DataFrame:
    """Rows of split entities with the name of their split."""
    return rows.join(split.select(spec.entity, "split"), spec.entity)


def split_statistics(split: DataFrame, spec: VisitSpec) -> DataFrame:
    """Size, share and class balance of each split."""
    y = F.col(spec.target)
    per = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(y == 1).alias("n_positive"),
        F.count_if(y == 0).alias("n_negative"))
    total = F.sum("n_entities").over(Window.partitionBy(F.lit(1)))   # over one row per split
    return per.select(
        "split", "n_entities", F.round(F.col("n_entities") / total, 4).alias("fraction"),
        "n_positive", "n_negative",
        F.round(F.col("n_positive") / F.col("n_entities"), 4).alias("positive_rate"))


def overlapping_entities(split: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entities that are in more than one split; must be empty."""
    return (split.groupBy(spec.entity).agg(F.count_distinct("split").alias("n_splits"))
            .filter("n_splits > 1"))


def assert_no_overlap(split: DataFrame, spec: VisitSpec) -> None:
    bad = overlapping_entities(split, spec).limit(5).collect()
    if bad:
        raise DataError(f"entities in several splits, for example {[r[0] for r in bad]}")


def expected_sizes(n: int, sizes: SplitSizes) -> tuple[int, int, int]:
    """Train, validation and test sizes of :func:`stratified_split` for ``n`` entities."""
    n_test = math.ceil(n * sizes.test)
    n_val = math.ceil((n - n_test) * (sizes.validation / (sizes.train + sizes.validation)))
    return n - n_test - n_val, n_val, n_test
