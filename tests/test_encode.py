"""Sparse one-hot features: equal to the dense ones, and free of the number of labels."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helpers import SPEC, history, timeline, without_future
from visitloom.operators import preprocess as pp, sequence as se
from visitloom.operators.encode import SparseEncoder


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", "x"), (2, None, "b", None), (3, 5.0, " A ", "y"), (4, float("nan"), "nan", "x"), (5, 2.0, "new", "z")],
        "id int, `n.1` double, s string, t string")


def dense(df):
    return {r["id"]: list(r["v"]) for r in df.select("id", vector_to_array("features").alias("v")).collect()}


def test_vectors_equal_dense_columns(spark, rows, tmp_path):
    train = rows.filter("id < 5")
    e = SparseEncoder.fit(train, ["n.1", "absent"], ["s", "t", "gone"])
    p = pp.Preprocessor.fit(train.withColumnRenamed("n.1", "n1"), ["n1", "absent"], ["s", "t", "gone"])
    assert e.output_names == ["n.1", *p.output_names[1:]] and e.width == len(p.output_names)
    want = {r["id"]: list(r)[1:] for r in p.transform(rows.withColumnRenamed("n.1", "n1"), ["id"]).collect()}
    assert dense(e.vectors(rows, ["id"])) == want
    e.write(spark, str(tmp_path / "e"))
    again = SparseEncoder.read(spark, str(tmp_path / "e"))
    assert dense(again.vectors(rows, ["id"])) == want
    assert dense(again.vectors(rows.drop("s"), ["id"]))[1] == [want[1][0], want[1][1], 0.0, 0.0, 0.0, 0.0, *want[1][6:]]


def test_many_labels(spark):
    """50,000 labels: no cap, small vectors, and a plan as long as that of two labels."""
    many = spark.range(50_000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), F.col("id") % 50_000).alias("s"))
    few = spark.range(50_000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), F.col("id") % 2).alias("s"))
    e, small = SparseEncoder.fit(many, [], ["s"]), SparseEncoder.fit(few, [], ["s"])
    assert (e.width, small.width) == (50_000, 2)
    out = e.vectors(many, ["id"])
    nonzero = F.udf(lambda v: int(v.numNonzeros()), "int")
    assert [tuple(r) for r in out.groupBy(nonzero("features").alias("k")).count().collect()] == [(1, 50_000)]

    def length(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert length(out) == length(small.vectors(few, ["id"]))


def test_no_rows_and_no_categories(spark):
    empty = spark.createDataFrame([], "id int, x double, s string")
    e = SparseEncoder.fit(empty, ["x"], ["s"])
    assert e.width == 1 and dense(e.vectors(spark.createDataFrame([(1, 3.0, "q")], empty.schema), ["id"])) == {1: [3.0]}
    assert e.vectors(empty, ["id"]).count() == 0


def test_sequences_from_a_vocabulary_table(spark):
    obs = without_future(timeline(spark, history(spark, n=3)))
    table = se.vocabulary(obs, SPEC)
    vocab = se.collect_vocabulary(table)
    a, b = (sorted(map(str, se.sequences(obs, SPEC, v).collect())) for v in (table, vocab))
    assert a == b
    wide = se.slot_table(spark, vocab)[0].unionByName(spark.range(30_000).select(
        F.lit("sex").alias("feature"), (F.col("id") + 100).cast("int").alias("slot"), F.concat(F.lit("l"), "id").alias("label")))
    assert se.visit_vectors(obs, SPEC, wide).count() == 3
