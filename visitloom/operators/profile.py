"""Descriptive tables about a long visit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import missing_to_null, number_or_null
from ..sources.session import written
from ..spec import VisitSpec
from .ordered import first_rows
from .quality import duplicate_groups
from .quantiles import column_quantiles


def visits_per_entity(df: DataFrame, spec: VisitSpec) -> DataFrame:
    return df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n_visits"))


def dataset_counts(df: DataFrame, spec: VisitSpec, **kw) -> DataFrame:
    """One row: rows, columns, entities, visits per entity, date range."""
    per = written(df.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("_n"), F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi")), "per-entity")
    one = per.groupBy().agg(
        F.sum("_n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        F.count(F.lit(1)).alias("n_entities"), F.min("_n").alias("visits_min"),
        F.max("_n").alias("visits_max"), F.round(F.avg("_n"), 2).alias("visits_mean"),
        F.min("_lo").alias("date_min"), F.max("_hi").alias("date_max"))
    median = column_quantiles(per, ["_n"], {"median": 0.5}, **kw).first()["median"]     # one row
    return one.withColumn("visits_median", F.lit(median).cast("double"))


def numeric_summary(df: DataFrame, spec: VisitSpec, *, stored: bool = False, **kw) -> DataFrame:
    """Count, missing, mean, std, min, quartiles and max per numeric column that has values.

    The columns are written once, as they are read several times, unless ``df`` is ``stored`` already.
    """
    present = [c for c in spec.numeric if c in df.columns]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in present])
    rows = rows if stored or not present else written(rows, "numeric")
    found = column_quantiles(rows, present, {"p25": .25, "median": .5, "p75": .75}, **kw).filter("count > 0")
    missing = F.col("n_rows") - F.col("count")
    return found.select(
        "column", "count", missing.alias("missing"), F.round(missing / F.col("n_rows"), 4).alias("missing_rate"),
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


def category_counts(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """``column, value, n``; missing spellings are one NULL value."""
    present = [c for c in spec.categorical if c in df.columns]
    return (df.select(*[missing_to_null(F.col(c)).alias(c) for c in present])
            .unpivot([], present, "column", "value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def categorical_summary(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Distinct values, missing rows and missing rate per categorical column."""
    value, n = F.col("value"), F.col("n")
    missing = F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0))
    return category_counts(df, spec).groupBy("column").agg(
        F.count("value").alias("n_unique"), missing.alias("missing"),
        F.round(missing / F.sum(n), 4).alias("missing_rate"))


def target_distribution(df: DataFrame, spec: VisitSpec, ordinal: list[str] | None = None) -> DataFrame:
    """Positive, negative and unknown entities, by the target of each entity's first row."""
    order = [F.col(c) for c in (ordinal or spec.order)]
    y = F.col(spec.target)
    return first_rows(df, [spec.entity], order, 1).groupBy().agg(
        F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"),
        F.count_if(y.isNull()).alias("n_unknown"),
        F.round(F.try_divide(F.count_if(y == 1), F.count_if(y.isin(0, 1))), 4).alias("positive_rate"))


def missingness(df: DataFrame) -> DataFrame:
    """Missing rate of every column that has NULLs or NaNs, from one pass."""
    names = df.columns
    numbers = {c for c, kind in df.dtypes if kind in ("double", "float")}
    counts = df.groupBy().agg(F.count(F.lit(1)).alias("_n"),
                              *[F.count_if((number_or_null(F.col(c)) if c in numbers else F.col(c)).isNull()).alias(c)
                                for c in names])
    long = counts.unpivot(["_n"], names, "column", "n_missing").filter("n_missing > 0")
    return long.select("column", "n_missing", F.round(F.col("n_missing") / F.col("_n"), 4).alias("missing_rate"))


def duplicate_count(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Rows beyond the first of every (entity, date)."""
    return duplicate_groups(df, spec).groupBy().agg(
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_duplicates"))


def dataset_metadata(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entities, visits, realised prevalence and realised missing rate of numeric cells."""
    present = [c for c in spec.numeric if c in df.columns]
    nulls = sum((number_or_null(F.col(c)).isNull().cast("long") for c in present), F.lit(0))
    y = F.max(spec.target) if spec.target in df.columns else F.lit(None).cast("int")
    per = df.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_null"), y.alias("_y"))
    return per.groupBy().agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("_n").alias("n_visits"),
        F.round(F.avg("_y"), 4).alias("prevalence"),
        F.round(F.sum("_null") / (F.sum("_n") * len(present)), 4).alias("missing_rate"))
