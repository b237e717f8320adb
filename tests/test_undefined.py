"""Undefined values: one answer whatever the size of a task, NaN as missing, refused input."""

import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helpers import SPEC
from visitloom.functions import as_flag, falling_cut, number_or_null
from visitloom.operators import metrics as me, ordered, preprocess as pp, profile as pr, splits as sp, wide as wi
from visitloom.plans import models as mo, search as sr
from visitloom.spec import DataError

NAN = float("nan")


@pytest.fixture(scope="module")
def scores(spark):
    """Ties, NULLs and NaNs among 400 scores."""
    rows = [(i % 4, int(i * 7 % 5 == 0), None if i % 10 == 0 else NAN if i % 13 == 0 else (i * 37 % 50) / 50.0)
            for i in range(400)]
    return spark.createDataFrame(rows, "g int, y int, p double").repartition(5).cache()


@pytest.mark.parametrize("fn", [me.auroc, me.auprc, me.metric_row, me.roc_points, me.pr_points])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_metrics_do_not_depend_on_the_cut(scores, fn, by):
    def rows(size):
        out = fn(scores, by=by, rows_per_task=size)
        return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in out.collect()), key=str)

    assert rows(5) == rows(10**6)


@pytest.mark.parametrize("falls", [True, False])
def test_positions_place_null_and_nan_as_the_sort_does(scores, falls):
    order = [F.col("p").desc() if falls else F.col("p").asc(), F.col("y"), F.col("g"), F.col("i")]
    rows = scores.withColumn("i", F.monotonically_increasing_id()).cache()
    cut = falling_cut(F.col("p")) if falls else F.when(F.col("p").isNull(), float("-inf")).otherwise(F.col("p"))
    got = [{r.i: r.at for r in ordered.positions(rows, [], order, [cut, *[F.col(c).cast("double") for c in ("y", "g", "i")]], "at",
                                                 rows_per_task=n).collect()} for n in (20, 10**6)]
    assert got[0] == got[1]


def test_undefined_scores_are_counted(scores):
    r = me.undefined_scores(scores).first()
    assert (r.n_rows, r.n_no_score, r.n_no_label) == (400, 40 + sum(i % 13 == 0 and i % 10 > 0 for i in range(400)), 0)


def test_nan_is_missing(spark):
    rows = [("A", i, 5.0 + i if i != 1 else NAN) for i in range(3)]
    df = spark.createDataFrame(rows, "patient_id string, visit_id long, hba1c double").withColumn(
        "visit_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("visit_id").cast("int")))
    w = wi.wide_features(df, SPEC).first()
    assert (w.hba1c_mean, w.hba1c_max, w.hba1c_delta, w.hba1c_slope) == (6.0, 7.0, 2.0, 1.0)
    fitted = pp.fit_numeric(df, ["hba1c"]).first()
    assert (fitted["median"], fitted["mean"]) == (6.0, 6.0) and math.isclose(fitted["std"], math.sqrt(2))
    s = pr.numeric_summary(df, SPEC).filter("column = 'hba1c'").first()
    assert (s["count"], s["missing"], s["mean"]) == (2, 1, 6.0)
    assert {r.column for r in pr.missingness(df).collect()} == {"hba1c"}
    assert df.select(number_or_null(F.col("hba1c")).alias("x")).filter("x is null").count() == 1


@pytest.mark.parametrize("values,kind,want", [
    ([1.0, 2.0, 0.0, NAN, None], "double", [True, True, False, False, False]),
    ([1, 3, 0, None], "int", [True, True, False, False]), ([True, False, None], "boolean", [True, False, False]),
    (["True", " 1 ", "no", "0", None], "string", [True, True, False, False, False])])
def test_flags_by_type(spark, values, kind, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, f {kind}")
    assert [r.x for r in df.select("i", as_flag(df, "f").alias("x")).orderBy("i").collect()] == want


def test_first_rows_of_many(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    out = ordered.first_rows(df, ["k"], [F.col("id")], 2000, cuts=[F.col("id").cast("double")], rows_per_task=500)
    assert out.groupBy("k").agg(F.count("*"), F.max("id"), F.max("_rank")).collect()[0][1:] in (
        (2000, 3998, 2000), (2000, 3999, 2000))
    assert out.count() == 4000


def test_too_few_entities(spark):
    two = spark.createDataFrame([("A", 0), ("B", 1)], "patient_id string, target int")
    with pytest.raises(DataError):
        sp.stratified_split(two, SPEC)
    with pytest.raises(DataError):
        sp.internal_split(two.limit(1), SPEC, 0.5)


@pytest.fixture(scope="module")
def training(spark):
    x = [F.sin(F.col("id") * k) for k in (1, 2, 3)]
    return spark.range(300).select(array_to_vector(F.array(*x)).alias("features"),
                                   (F.sin(F.col("id")) + F.sin(F.col("id") * 7) > 0.2).cast("double").alias("label"))


@pytest.mark.parametrize("family,params", [
    ("random_forest", {"n_estimators": 5, "max_depth": 4}),
    ("gradient_boosting", {"n_estimators": 3, "max_depth": 3, "subsample": 0.7})])
def test_one_seed_gives_one_model(training, family, params):
    def scored(df):
        return [round(r.p, 12) for r in mo.fit(family, params, df).predict_proba(training).select("p").collect()]

    assert scored(training.coalesce(1)) == scored(training.repartition(7))


def test_depth_is_refused(training):
    with pytest.raises(ValueError):
        mo.fit("random_forest", {"max_depth": 31}, training)


def test_failed_trials_are_on_the_board(spark, training):
    trials = [sr.Trial(0, "random_forest", (("max_depth", 40),)), sr.Trial(1, "logistic_regression", (("C", 1.0),))]
    board = sr.run_search(spark, trials, {mo.WIDE: (training, training)}).leaderboard.collect()
    assert [(r.trial, r.state) for r in board] == [(1, "complete"), (0, "failed")]
    assert "40" in board[1].hyperparameters and board[1].validation_auroc is None
