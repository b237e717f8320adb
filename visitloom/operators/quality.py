"""Validation of a long visit table: one finding row per failed check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import is_missing, missing_to_null, sort_cuts, try_date
from ..sources.session import written
from ..spec import VisitSpec
from .guards import leakage_candidates
from .ordered import running

ERROR, WARNING = "error", "warning"
FINDING = "level string, code string, n long, details string"
SAMPLE = 10


def _as_date(df: DataFrame, name: str) -> Column:
    return try_date(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def duplicate_groups(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entity and date pairs that occur more than once, with their row count."""
    return (df.groupBy(spec.entity, spec.time).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))


def unordered_entities(df: DataFrame, spec: VisitSpec, ordinal: str, **kw) -> DataFrame:
    """Entities whose dates go back in time along ``ordinal``, the order of arrival."""
    rows = df.select(spec.entity, ordinal, _as_date(df, spec.time).alias("_t"))
    seen = running(rows, [spec.entity], [F.col(ordinal)], sort_cuts(df, [ordinal]),
                   before={"_latest": ("max", F.col("_t"))}, **kw)
    return seen.filter(F.col("_latest") > F.col("_t")).select(spec.entity).distinct()


def inconsistent_targets(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entities with more than one distinct target."""
    return (df.groupBy(spec.entity).agg(F.min(spec.target).alias("_l"), F.max(spec.target).alias("_h"))
            .filter("_l <> _h").select(spec.entity))


def invalid_yes_no(df: DataFrame, spec: VisitSpec, allowed: tuple[str, ...] = ("yes", "no")) -> DataFrame:
    """``column, value, n`` for every value of a yes/no column that is neither."""
    present = [c for c in spec.yes_no if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    long = df.select(*[F.lower(missing_to_null(F.col(c))).alias(c) for c in present]).unpivot(
        [], present, "column", "value")
    return (long.filter(F.col("value").isNotNull() & ~F.col("value").isin(*allowed))
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def invalid_targets(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """``value, n`` for targets other than 0 and 1."""
    y = F.col(spec.target)
    return (df.filter(y.isNotNull() & ~y.isin(0, 1)).groupBy(y.cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def _offences(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """``code, part, k, n`` of single rows, counted by what is wrong; only bad cells become rows, from one scan."""
    have, cells = set(df.columns), []

    def offence(bad: Column, code: str, part: str = "", k: Column | None = None) -> None:
        value = F.lit(None).cast("string") if k is None else k.cast("string")
        cells.append(F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(part).alias("part"), value.alias("k"))))

    if spec.entity in have:
        offence(is_missing(F.col(spec.entity)), "EMPTY_PATIENT_ID")
    if spec.time in have:
        offence(_as_date(df, spec.time).isNull(), "INVALID_VISIT_DATE")
    if spec.target in have:
        offence(F.col(spec.target).isNotNull() & ~F.col(spec.target).isin(0, 1), "NON_BINARY_TARGET", k=F.col(spec.target))
    for c in spec.yes_no:
        if c in have:
            value = F.lower(missing_to_null(F.col(c)))
            offence(value.isNotNull() & ~value.isin("yes", "no"), "INVALID_BINARY_CATEGORICAL", c, value)
    if not cells:
        return df.sparkSession.createDataFrame([], "code string, part string, k string, n long")
    return df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("code", "part", "k").agg(
        F.count(F.lit(1)).alias("n"))


def _entity_offences(df: DataFrame, spec: VisitSpec) -> DataFrame | None:
    """The same of entities: repeated dates and targets that differ, from one scan, counted by date, then by entity."""
    have = set(df.columns)
    if spec.entity not in have:
        return None
    y = F.col(spec.target) if spec.target in have else F.lit(None).cast("int")
    per = df.groupBy(spec.entity, *([spec.time] if spec.time in have else [])).agg(
        F.count(F.lit(1)).alias("_n"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    dups = F.sum(F.when(F.col("_n") > 1, F.col("_n"))) if spec.time in have else F.lit(None).cast("long")
    each = per.groupBy(spec.entity).agg(dups.alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    none = F.lit(None).cast("string")
    return each.select(F.inline(F.array_compact(F.array(
        F.when(F.col("_d") > 0, F.struct(F.lit("DUPLICATE_PATIENT_DATE").alias("code"), F.lit("").alias("part"),
                                         none.alias("k"), F.col("_d").alias("n"))),
        F.when(F.col("_lo") != F.col("_hi"), F.struct(
            F.lit("INCONSISTENT_TARGET").alias("code"), F.lit("").alias("part"),
            F.col(spec.entity).cast("string").alias("k"), F.lit(1).cast("long").alias("n")))))))


def findings(df: DataFrame, spec: VisitSpec, *, expected: tuple[str, ...] = (), ordinal: str | None = None,
             allow_duplicates: bool = False, target_is_error: bool = True,
             blacklist: tuple[str, ...] = (), **kw) -> DataFrame:
    """All failed checks.  ``ordinal`` names the arrival order; without it that check is left out.

    Three scans: single rows, entities, and the order of arrival (which counts the rows of a table first, and its
    groups where the table is larger than a task).  What they find is written once as counts, and samples of the first
    ``SAMPLE`` offenders are taken from there, at most as many per task.
    """
    spark = df.sparkSession
    have = set(df.columns)
    fixed = [(ERROR, "MISSING_REQUIRED_COL", 1, c) for c in (spec.entity, spec.time) if c not in have]
    absent = [c for c in expected if c not in have]
    if absent:
        fixed.append((WARNING, "MISSING_EXPECTED_COL", len(absent), ",".join(absent)))
    suspects = leakage_candidates(df.columns, spec, blacklist)
    if suspects:
        fixed.append((WARNING, "LEAKAGE_CANDIDATE_COLUMNS", len(suspects), ",".join(suspects)))
    found = [_offences(df, spec), _entity_offences(df, spec)]
    if ordinal and {spec.entity, spec.time} <= have:
        late = unordered_entities(df, spec, ordinal, **{"at_most": df.select(F.lit(1)), **kw})
        found.append(late.select(F.lit("NON_CHRONOLOGICAL_ORDER").alias("code"), F.lit("").alias("part"),
                                 F.col(spec.entity).cast("string").alias("k"), F.lit(1).cast("long").alias("n")))
    bad = written(reduce(DataFrame.unionByName, [f for f in found if f is not None]), "offences")
    first = Window.partitionBy("code", "part").orderBy("k")
    sample = bad.filter(F.col("k").isNotNull()).withColumn("_i", F.row_number().over(first)).filter(
        F.col("_i") <= SAMPLE).groupBy("code", "part").agg(
        F.array_join(F.array_sort(F.collect_list("k")), ",").alias("details"))      # at most a sample each
    total = F.when(F.max("k").isNull(), F.sum("n")).otherwise(F.count(F.lit(1)))    # offenders, or rows without a name
    counts = bad.groupBy("code", "part").agg(total.alias("n"))
    level = F.create_map(*[F.lit(x) for pair in {
        "EMPTY_PATIENT_ID": ERROR, "INVALID_VISIT_DATE": ERROR, "NON_BINARY_TARGET": ERROR,
        "DUPLICATE_PATIENT_DATE": WARNING if allow_duplicates else ERROR, "NON_CHRONOLOGICAL_ORDER": WARNING,
        "INCONSISTENT_TARGET": ERROR if target_is_error else WARNING,
        "INVALID_BINARY_CATEGORICAL": WARNING}.items() for x in pair])
    rows = counts.join(sample, ["code", "part"], "left").select(
        F.element_at(level, F.col("code")).alias("level"), "code", "n",
        F.when(F.col("part") != "", F.col("part")).otherwise(F.coalesce("details", F.lit(""))).alias("details"))
    return spark.createDataFrame(fixed, FINDING).unionByName(rows)


def passed(found: DataFrame) -> bool:
    """True when no finding is an error."""
    return found.filter(F.col("level") == ERROR).isEmpty()
