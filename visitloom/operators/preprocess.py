"""Statistics fitted on training rows, applied to any rows.

The fitted state is two small tables, one row per numeric feature and one row
per category.  Imputation uses the median of the non-missing values; scaling
uses their mean and sample standard deviation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import missing_to_null, number_or_null, quoted
from ..sources.session import written
from ..spec import MISSING_LABEL, DataError, VisitSpec
from .quantiles import column_quantiles

MAX_CATEGORIES = 20_000


def split_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric columns, and all others."""
    fields = [f for f in df.schema if f.name not in exclude]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def column_statistics(table: DataFrame, columns: list[str], **kw) -> DataFrame:
    """``feature, median, mean, std`` per column of a stored table; 0, 0, 1 without values; std 0 becomes 1."""
    found = column_quantiles(table, columns, {"median": 0.5}, **kw)
    return found.select(
        F.col("column").alias("feature"), F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std"))


def fit_numeric(train: DataFrame, columns: list[str], *, stored: bool = False, **kw) -> DataFrame:
    """``feature, median, mean, std``; 0, 0, 1 for a feature without values; std 0 becomes 1.

    The columns are written once, as they are read several times, unless ``train`` is ``stored`` already.
    """
    present = [c for c in columns if c in train.columns]
    rows = train.select(*[quoted(c).cast("double").alias(c) for c in present])
    rows = rows if stored or not present else written(rows, "numeric")
    absent = {c: F.lit(None).cast("double") for c in columns if c not in present}
    return column_statistics(rows.withColumns(absent) if absent else rows, columns, **kw)


def fit_categories(train: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, category``: the distinct training values, missing as its own category."""
    present = [c for c in columns if c in train.columns]
    return (train.select(*[F.coalesce(missing_to_null(F.col(c)), F.lit(MISSING_LABEL)).alias(c)
                           for c in present])
            .unpivot([], present, "feature", "category").distinct())


@dataclass(frozen=True)
class Preprocessor:
    """Fitted state on the driver: one entry per feature, one per category."""

    numeric: tuple[tuple[str, float, float, float], ...]
    categories: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def output_names(self) -> list[str]:
        return [n[0] for n in self.numeric] + [f"{c}__{v}" for c, vs in self.categories for v in vs]

    @classmethod
    def fit(cls, train: DataFrame, numeric: list[str], categorical: list[str], **kw) -> "Preprocessor":
        train = train.select(*[c for c in (*numeric, *categorical) if c in train.columns]).persist()
        try:   # read for the count, the statistics and the categories
            stats = {r["feature"]: r for r in fit_numeric(train, numeric, stored=True, **kw).collect()} if numeric else {}
            rows = (fit_categories(train, categorical).limit(MAX_CATEGORIES + 1).collect()
                    if categorical else [])
        finally:
            train.unpersist()
        if len(rows) > MAX_CATEGORIES:
            raise DataError(f"more than {MAX_CATEGORIES} categories to encode")
        cats: dict[str, list[str]] = {c: [] for c in categorical}
        for r in rows:
            cats[r["feature"]].append(r["category"])
        return cls(
            tuple((c, float(stats[c]["median"]), float(stats[c]["mean"]), float(stats[c]["std"]))
                  if c in stats else (c, 0.0, 0.0, 1.0) for c in numeric),
            tuple((c, tuple(sorted(v))) for c, v in cats.items()))

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and one column per output name; unseen categories are all zero."""
        cols = []
        for c, median, mean, std in self.numeric:
            x = number_or_null(F.col(c)) if c in df.columns else F.lit(None).cast("double")
            cols.append(((F.coalesce(x, F.lit(median)) - F.lit(mean)) / F.lit(std)).alias(c))
        out = df
        for c, values in self.categories:
            label = (F.coalesce(missing_to_null(F.col(c)), F.lit(MISSING_LABEL)) if c in df.columns
                     else F.lit(None).cast("string"))
            out = out.withColumn(f"_cat_{c}", label)
            cols += [F.coalesce((F.col(f"_cat_{c}") == v).cast("double"), F.lit(0.0)).alias(f"{c}__{v}")
                     for v in values]
        return out.select(*keep, *cols)

    def write(self, spark, path: str) -> None:
        """One row per numeric feature and one per category."""
        rows = [("numeric", i, c, None, a, b, s) for i, (c, a, b, s) in enumerate(self.numeric)]
        rows += [("category", i, c, v, None, None, None)
                 for i, (c, vs) in enumerate(self.categories) for v in vs]
        spark.createDataFrame(
            rows, "kind string, position int, feature string, category string, "
                  "median double, mean double, std double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark, path: str) -> "Preprocessor":
        rows = spark.read.parquet(path).collect()   # as many rows as output columns
        numeric = sorted((r for r in rows if r["kind"] == "numeric"), key=lambda r: r["position"])
        cats: dict[tuple[int, str], list[str]] = {}
        for r in rows:
            if r["kind"] == "category":
                cats.setdefault((r["position"], r["feature"]), []).append(r["category"])
        return cls(tuple((r["feature"], r["median"], r["mean"], r["std"]) for r in numeric),
                   tuple((c, tuple(sorted(v))) for (_, c), v in sorted(cats.items())))


def fit_sequence_stats(packed: DataFrame, spec: VisitSpec, names: list[str], **kw) -> DataFrame:
    """``feature, median, mean, std`` of the numeric slots over real steps."""
    numeric = [n for n in names if n in spec.numeric]
    steps = (packed.select(F.posexplode("X").alias("_step", "_v"), "mask")
             .filter(F.get("mask", F.col("_step")) == 1)
             .select(*[F.get("_v", F.lit(names.index(n))).alias(n) for n in numeric]))
    return column_statistics(written(steps, "steps"), numeric, **kw)


def apply_sequence_stats(packed: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Impute and scale numeric slots of real steps; padding becomes zero."""
    found = {r["feature"]: r for r in stats.collect()}   # one row per numeric slot
    head = max((j + 1 for j, name in enumerate(names) if name in found), default=0)   # numbers come first

    def step(vector, index):
        cells = []
        for j, name in enumerate(names[:head]):
            x = F.get(vector, F.lit(j))
            if name in found:
                r = found[name]
                x = (F.coalesce(number_or_null(x), F.lit(r["median"])) - F.lit(r["mean"])) / F.lit(r["std"])
            cells.append(x)
        real = F.concat(F.array(*cells).cast("array<double>"), F.slice(vector, head + 1, len(names)))
        return F.when(F.get("mask", index) == 1, real).otherwise(F.transform(vector, lambda _: F.lit(0.0)))

    return packed.withColumn("X", F.transform("X", step))
