"""Metrics against brute force, calibration and agreement of explanations."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitloom.operators import calibration as ca, metrics as me, stability as st
from visitloom.spec import DataError


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(y, [float(x) for x in p])), "y int, p double")


def brute_auroc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    return sum(pairs) / len(pairs)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    y = [int(rng.random() < 0.4) for _ in range(300)]
    return y, [round(min(1, max(0, 0.3 * t + rng.random() * 0.7)), 2) for t in y]


@pytest.mark.parametrize("rows_per_task", [6, 10_000])
def test_auroc_is_the_pair_count(spark, sample, rows_per_task):
    y, p = sample
    got = me.auroc(frame(spark, y, p), rows_per_task=rows_per_task).first().auroc
    assert math.isclose(got, brute_auroc(y, p))


def test_auroc_extremes(spark):
    assert me.auroc(frame(spark, [0, 0, 1, 1], [.1, .2, .8, .9])).first().auroc == 1.0
    assert me.auroc(frame(spark, [1, 1, 0, 0], [.1, .2, .8, .9])).first().auroc == 0.0
    assert me.auroc(frame(spark, [1, 0], [.5, .5])).first().auroc == 0.5
    assert me.auroc(frame(spark, [1, 1], [.1, .2])).first().auroc is None
    assert me.auprc(frame(spark, [0, 0], [.1, .2])).first().auprc is None


def test_auprc_by_hand(spark):
    # order: negative .9, positive .8, negative .5, positive .1; the curve starts at (0, 1)
    got = me.auprc(frame(spark, [0, 1, 0, 1], [.9, .8, .5, .1])).first().auprc
    assert math.isclose(got, 0.5 * (1 + 1 / 2) / 2 + 0.5 * (1 / 3 + 2 / 4) / 2)
    assert me.auprc(frame(spark, [0, 0, 1, 1], [.1, .2, .8, .9])).first().auprc == 1.0


def test_threshold_metrics(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 1], [.1, .6, .4, .9, .3, .8])
    r = me.metric_row(df).first()
    assert (r.TP, r.FP, r.TN, r.FN) == (2, 1, 2, 1)
    assert math.isclose(r.specificity, 2 / 3) and math.isclose(r.f1, 2 / 3) and math.isclose(r.accuracy, 4 / 6)
    assert math.isclose(r.brier, me.brier(df).first().brier)
    none = me.threshold_rates(df, 0.99).first()
    assert none.precision is None and none.f1 is None and none.recall == 0.0


def test_points(spark):
    df = frame(spark, [1, 0, 1], [.9, .9, .2])
    roc = sorted((r.fpr, r.tpr) for r in me.roc_points(df).collect())
    assert roc == [(0.0, 0.0), (1.0, 0.5), (1.0, 1.0)]
    pr = {r.threshold: (r.precision, r.recall) for r in me.pr_points(df).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.9] == (0.5, 0.5)


def test_best_threshold(spark, sample):
    y, p = sample

    def f1(t):
        tp = sum(a and b >= t for a, b in zip(y, p))
        return 2 * tp / (sum(y) + sum(b >= t for b in p))

    best = max(me.F1_CANDIDATES, key=lambda t: (f1(t), -t))
    assert me.best_f1_threshold(frame(spark, y, p)).first().threshold == best
    assert me.best_f1_threshold(frame(spark, [0, 0], [.1, .9])).first().threshold is None


def test_grouped_equals_filtered(spark, sample):
    y, p = sample
    df = frame(spark, y, p).withColumn("g", F.when(F.col("p") * 100 % 2 < 1, "a"))   # one group is NULL
    for r in me.metric_row(df, by=["g"], prefix="x_").collect():
        one = me.metric_row(df.filter(F.col("g").eqNullSafe(F.lit(r.g)))).first()
        assert math.isclose(r.x_auroc, one.auroc) and math.isclose(r.x_auprc, one.auprc) and r.x_TP == one.TP


def test_reliability(spark):
    bins = ca.reliability_bins(frame(spark, [0, 1, 1], [.6, .6, 1.0]), 5).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [0, 0, 0, 2, 1] and bins[0].mean_predicted is None
    one = ca.calibration_report(frame(spark, [0, 1], [.6, .6]), 1).first()
    assert math.isclose(one.ece, 0.1) and one.mce_bin == 0 and one.mce_bin_count == 2


@pytest.mark.parametrize("y,p", [([2, 0], [.1, .2]), ([1, 0], [1.1, .2]), ([1, 0], [float("nan"), .2])])
def test_bad_predictions(spark, y, p):
    with pytest.raises(DataError):
        ca.check_predictions(frame(spark, y, p))


def test_no_predictions(spark):
    with pytest.raises(DataError):
        ca.check_predictions(frame(spark, [1], [.1]).filter("y > 5"))


def scores(spark, **kv):
    return spark.createDataFrame(list(kv.items()), "key string, score double")


def test_stability(spark):
    a = scores(spark, a=3.0, b=-5.0, c=1.0, d=0.5)
    b = scores(spark, a=30.0, b=-50.0, c=10.0, e=7.0)
    r = st.stability_report(a, b, 2).first()
    assert (r.k, r.shared_keys, r.spearman) == (2, 3, 1.0) and r.topk_jaccard == 1.0
    assert st.topk_jaccard(a, b, 0).first()[0] == 1.0
    assert math.isclose(st.topk_jaccard(a, b, 4).first()[0], 3 / 5)
    assert st.spearman(a, scores(spark, a=1.0, b=1.0)).first().spearman is None
    assert st.spearman(a, scores(spark, a=1.0)).first().spearman is None
    with pytest.raises(ValueError):
        st.topk_jaccard(a, b, -1)


@pytest.mark.parametrize("rows_per_task", [20, 10_000])
def test_large_ties_are_ranked_exactly(spark, rows_per_task):
    rng = random.Random(11)
    rows = [(f"k{i}", 0.0 if i % 3 == 0 else float(rng.randrange(150)), None if i == 5 else rng.random() * (i % 4))
            for i in range(400)]
    both = spark.createDataFrame(rows, "key string, x double, y double").repartition(5)
    a, b = both.selectExpr("key", "x as score"), both.selectExpr("key", "y as score")
    df = pd.DataFrame(rows, columns=["key", "x", "y"]).dropna()
    got = st.spearman(a, b, rows_per_task=rows_per_task).first()
    assert got.shared_keys == 399
    assert math.isclose(got.spearman, df.x.rank().corr(df.y.rank()), abs_tol=1e-12)
    ranks = st.average_ranks(b, "score", "rank", rows_per_task=rows_per_task).toPandas().set_index("key")["rank"]
    assert ranks.to_dict() == dict(zip(df.key, df.y.rank()))
    plan = st.average_ranks(a, "score", "rank", rows_per_task=20)._jdf.queryExecution().executedPlan().toString()
    assert "_to" in plan and re.search(r"_part#\d+", plan)


def test_ties_share_ranks(spark):
    r = st.average_ranks(scores(spark, a=1.0, b=2.0, c=2.0, d=3.0), "score", "rank")
    assert {x.key: x["rank"] for x in r.collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
    tie = st.top_k(scores(spark, z=1.0, b=-1.0, c=0.5), 1).first()
    assert tie.key == "b"
    ranking = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, place int")
    assert {x.key: x.score for x in st.scores_from_ranking(ranking, "name", "place").collect()} == {
        "x": 3.0, "y": 2.0, "z": 1.0}
