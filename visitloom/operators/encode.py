"""Wide rows as feature vectors, with categories looked up in a table of slots.

The slots of the categories are a distributed table, so neither the driver nor the plan knows the labels:
a row joins its own labels, one join per categorical column, and gets a sparse vector.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import missing_to_null, number_or_null, quoted, sort_cuts
from ..sources.session import written
from ..spec import MISSING_LABEL
from .ordered import positions
from .preprocess import fit_categories, fit_numeric


def label_of(df: DataFrame, name: str) -> Column:
    """The category of a row; a missing value is its own, an absent column has none."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.coalesce(missing_to_null(quoted(name)), F.lit(MISSING_LABEL))


@dataclass
class SparseEncoder:
    """Fitted state: a row per numeric feature and a count per categorical one; the categories are a table.

    ``slots`` has ``feature, category, slot``, slots from 0 in the order of the category.
    """

    numeric: tuple[tuple[str, float, float, float], ...]
    sizes: tuple[tuple[str, int], ...]
    slots: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, numeric: list[str], categorical: list[str], **kw) -> "SparseEncoder":
        used = [c for c in (*numeric, *categorical) if c in train.columns]
        train = written(train.select(*[quoted(c) for c in used]), "training-rows")      # read several times
        stats = {r["feature"]: r for r in fit_numeric(train, numeric, stored=True, **kw).collect()} if numeric else {}
        found = fit_categories(train, categorical) if any(c in train.columns for c in categorical) else \
            train.sparkSession.createDataFrame([], "feature string, category string")
        placed = positions(found, ["feature"], [F.col("category")], sort_cuts(found, ["category"]), "slot")
        slots = written(placed.select("feature", "category", F.col("slot").cast("int").alias("slot")), "slots")
        sizes = {r["feature"]: r["n"] for r in slots.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(tuple((c, float(stats[c]["median"]), float(stats[c]["mean"]), float(stats[c]["std"]))
                         for c in numeric), tuple((c, int(sizes.get(c, 0))) for c in categorical), slots)

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(n for _, n in self.sizes)

    def names(self) -> DataFrame:
        """``position, name`` of every vector entry: numeric features, then ``feature__category``."""
        spark, at, heads = self.slots.sparkSession, len(self.numeric), []
        for c, n in self.sizes:
            heads.append((c, at))
            at += n
        first = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(self.numeric)], "position int, name string")
        base = F.broadcast(spark.createDataFrame(heads, "feature string, base int"))     # a row per categorical column
        return first.unionByName(self.slots.join(base, "feature").select(
            (F.col("base") + F.col("slot")).alias("position"), F.concat_ws("__", "feature", "category").alias("name")))

    @property
    def output_names(self) -> list[str]:
        """The names on the driver, as explanations of single features list them."""
        return [r["name"] for r in self.names().orderBy("position").collect()]

    def vectors(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``features``: imputed and scaled numbers, then one slot per category; unseen ones have none."""
        cells = []
        for c, median, mean, std in self.numeric:
            x = number_or_null(quoted(c)) if c in df.columns else F.lit(None).cast("double")
            cells.append((F.coalesce(x, F.lit(median)) - F.lit(mean)) / F.lit(std))
        used = [(c, n) for c, n in self.sizes if n]
        rows = df.select(*keep, array_to_vector(F.array(*cells).cast("array<double>")).alias("_numbers"),
                         *[label_of(df, c).alias(f"_label{i}") for i, (c, _) in enumerate(used)])
        for i, (c, n) in enumerate(used):
            own = self.slots.filter(F.col("feature") == c).select(
                F.col("category").alias(f"_label{i}"), F.col("slot").alias(f"_slot{i}"))
            rows = rows.join(own, f"_label{i}", "left")
            kind = {"ml_attr": {"type": "nominal", "num_vals": n}}      # the encoder reads the size here, not the data
            rows = rows.withColumn(f"_slot{i}", F.coalesce(f"_slot{i}", F.lit(n)).cast("double").alias(
                f"_slot{i}", metadata=kind))
        if used:
            slots = [f"_slot{i}" for i in range(len(used))]
            hot = [f"_hot{i}" for i in range(len(used))]
            rows = OneHotEncoder(inputCols=slots, outputCols=hot, handleInvalid="keep").fit(rows).transform(rows)
        parts = (["_numbers"] if self.numeric else []) + ([f"_hot{i}" for i in range(len(used))])
        sized = rows.withColumn("_numbers", F.col("_numbers").alias(
            "_numbers", metadata={"ml_attr": {"num_attrs": len(self.numeric)}}))
        done = VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep").transform(sized)
        return done.select(*keep, "features")

    def cells(self, vectors: DataFrame, keep: list[str]) -> DataFrame:
        """``keep, name, value`` of every entry that is not 0."""
        long = vectors.select(*keep, F.posexplode(vector_to_array("features")).alias("position", "value")).filter("value <> 0")
        return long.join(self.names(), "position").select(*keep, "name", "value")

    def write(self, spark: SparkSession, path: str) -> None:
        meta = json.dumps({"numeric": self.numeric, "sizes": self.sizes})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fitted")
        self.slots.write.mode("overwrite").parquet(f"{path}/slots")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "SparseEncoder":
        meta = json.loads(spark.read.text(f"{path}/fitted").first()[0])
        return cls(tuple((c, *map(float, v)) for c, *v in meta["numeric"]), tuple((c, n) for c, n in meta["sizes"]),
                   spark.read.parquet(f"{path}/slots"))
