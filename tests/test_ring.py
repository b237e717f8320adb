"""Permutation importance by turning a ring of entities."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.queries import FixedScorer
from visitloom.plans import explain as ex


def rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("e"), (F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array(
            (F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"), F.lit(1.0))).alias("features"))


def importance(df, scorer, **kw):
    return {r.feature: r.importance for r in ex.permutation_importance(scorer, df, "e", ["a", "b", "c"], **kw).collect()}


def test_only_used_features_matter(spark):
    got = importance(rows(spark, 400), FixedScorer(0.0, [3.0, 0.0, 1.0]), repeats=4)
    assert got["a"] > 0.1 and got["b"] == 0.0 and got["c"] == 0.0
    assert got == importance(rows(spark, 400).repartition(7), FixedScorer(0.0, [3.0, 0.0, 1.0]), repeats=4)
    assert got == importance(rows(spark, 400), FixedScorer(0.0, [3.0, 0.0, 1.0]), repeats=4, rows_per_task=50)


def test_one_row_and_none(spark):
    assert set(importance(rows(spark, 1), FixedScorer(0.0, [1.0, 1.0, 1.0])).values()) <= {0.0}
    assert importance(rows(spark, 0), FixedScorer(0.0, [1.0, 1.0, 1.0])) == {}
