"""Disjoint, exact, reproducible splits of entities."""

import math

import pytest
from pyspark.sql import functions as F

from visitloom.operators import splits as sp
from visitloom.spec import DataError, SplitSizes, VisitSpec

SPEC = VisitSpec()


@pytest.fixture(scope="module")
def labeled(spark):
    return spark.range(100).select(
        F.format_string("P%03d", "id").alias("patient_id"), (F.col("id") < 30).cast("int").alias("target"))


def members(df):
    return {r.patient_id: r.split for r in df.collect()}


def test_exact_sizes_and_balance(labeled):
    s = sp.stratified_split(labeled, SPEC)
    n = {r.split: r for r in sp.split_statistics(s, SPEC).collect()}
    assert tuple(n[k].n_entities for k in ("train", "validation", "test")) == sp.expected_sizes(100, SplitSizes())
    assert all(abs(r.positive_rate - 0.3) < 0.05 for r in n.values())
    sp.check_split(s, SPEC)
    sp.assert_no_overlap(s, SPEC)
    assert s.count() == 100


@pytest.mark.parametrize("rows_per_task", [5, 1000])
def test_independent_of_order_and_partitioning(labeled, rows_per_task):
    a = members(sp.stratified_split(labeled, SPEC))
    b = members(sp.stratified_split(labeled.orderBy(F.rand(1)).repartition(7), SPEC, rows_per_task=rows_per_task))
    assert a == b
    assert a != members(sp.stratified_split(labeled, SPEC, seed=7))


def test_plain_split_has_the_same_sizes(labeled):
    n = {r.split: r["count"] for r in sp.stratified_split(
        labeled, SPEC, stratify=False).groupBy("split").count().collect()}
    # sizes are rounded up, and 85 * (0.15 / 0.85) is a little more than 15 in floating point
    assert (n["train"], n["validation"], n["test"]) == sp.expected_sizes(100, SplitSizes()) == (69, 16, 15)


def test_internal_split(labeled):
    n = sp.internal_split(labeled, SPEC, 0.2).groupBy("split", "target").count()
    assert {(r.split, r.target): r["count"] for r in n.collect()} == {
        ("train", 0): 56, ("train", 1): 24, ("validation", 0): 14, ("validation", 1): 6}
    single = labeled.withColumn("target", (F.col("patient_id") == "P000").cast("int"))
    n = sp.internal_split(single, SPEC, 0.2).groupBy("split").count()
    assert {r.split: r["count"] for r in n.collect()} == {"train": 80, "validation": 20}


def test_chronological(spark, labeled):
    visits = labeled.select("patient_id", F.date_add(F.lit("2020-01-01").cast("date"),
                            -F.substring("patient_id", 2, 3).cast("int")).alias("visit_date"))
    s = members(sp.chronological_split(visits, labeled, SPEC))
    assert [s[f"P{i:03d}"] for i in (99, 30, 29, 15, 14, 0)] == ["train"] * 2 + ["validation"] * 2 + ["test"] * 2


def test_impossible_splits_raise(spark, labeled):
    with pytest.raises(DataError):
        sp.check_split(sp.stratified_split(labeled.withColumn("target", F.lit(0)), SPEC), SPEC)
    with pytest.raises(DataError):
        sp.check_split(sp.stratified_split(labeled.limit(2), SPEC), SPEC)
    with pytest.raises(ValueError):
        SplitSizes(0.5, 0.2, 0.2)
    both = labeled.withColumn("split", F.lit("a")).unionByName(labeled.limit(1).withColumn("split", F.lit("b")))
    with pytest.raises(DataError):
        sp.assert_no_overlap(both, SPEC)


def test_candidates_need_both_tables(spark, labeled):
    visits = spark.createDataFrame([("P001",), ("P001",), ("X",)], "patient_id string")
    assert [r.patient_id for r in sp.candidates(visits, labeled, SPEC).collect()] == ["P001"]


@pytest.mark.parametrize("n, classes", [(100_000, 100_000), (4_000, 1_300)])
def test_many_classes_are_shared_out_exactly(spark, n, classes):
    """More classes than are planted as constants: exact sizes, and the shares of the constants' way."""
    df = spark.range(n).select(F.col("id").cast("string").alias("patient_id"), (F.col("id") % classes).alias("target"))
    sizes = sp.SplitSizes()
    got = {r["split"]: r["count"] for r in sp.stratified_split(df, SPEC, sizes).groupBy("split").count().collect()}
    n_test = math.ceil(n * sizes.test)
    n_val = math.ceil((n - n_test) * (sizes.validation / (sizes.train + sizes.validation)))
    assert got == {"test": n_test, "validation": n_val, "train": n - n_test - n_val}
    inner = {r["split"]: r["count"] for r in sp.internal_split(df, SPEC, 0.2).groupBy("split").count().collect()}
    assert inner == {"validation": round(n * 0.2), "train": n - round(n * 0.2)}


def test_both_ways_give_one_split(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").cast("string").alias("patient_id"), F.when(
        F.col("id") % 9 > 0, (F.col("id") * 7 % 40 % 13).cast("int")).alias("target"))
    few = [sorted(map(tuple, f(df).collect())) for f in (lambda d: sp.stratified_split(d, SPEC),
                                                          lambda d: sp.internal_split(d, SPEC, 0.3))]
    monkeypatch.setattr(sp, "MAX_CLASSES", 3)
    many = [sorted(map(tuple, f(df).collect())) for f in (lambda d: sp.stratified_split(d, SPEC, rows_per_task=6),
                                                           lambda d: sp.internal_split(d, SPEC, 0.3))]
    assert few == many
