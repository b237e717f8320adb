"""Running totals agree with plain windows, whatever the size of a group."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from visitloom.functions import sort_cuts
from visitloom.operators.ordered import first_rows, positions, running
from visitloom.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        # a third of the hot key's rows share one day
        day = 100 if rng.random() < 0.35 else rng.randrange(400)
        rows.append((key, dt.date(2020, 1, 1) + dt.timedelta(days=day), i, rng.random() * 10))
    return spark.createDataFrame(rows, "k string, d date, i long, v double").repartition(6)


@pytest.mark.parametrize("rows_per_task", [7, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_window(skewed, rows_per_task, keys):
    got = running(
        skewed, keys, [F.col("d"), F.col("i")], sort_cuts(skewed, ["d", "i"]),
        before={"pos": ("count", None), "s": ("sum", F.col("v")), "hi": ("max", F.col("v"))},
        group={"n": ("sum", F.lit(1)), "last": ("max", F.col("d"))}, rows_per_task=rows_per_task)
    assert set(got.columns) == set(skewed.columns) | {"pos", "s", "hi", "n", "last"}
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    w = part.orderBy("d", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "i", (F.row_number().over(part.orderBy("d", "i")) - 1).alias("pos"),
        F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"), F.max("v").over(w).alias("hi"),
        F.count("*").over(part).alias("n"), F.max("d").over(part).alias("last"))
    a = got.select(*want.columns).toPandas().sort_values("i").reset_index(drop=True)
    b = want.toPandas().sort_values("i").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("rows_per_task", [7, 10_000])
def test_last_value_of_a_group_skips_null(spark, rows_per_task):
    rows = [("big", i, f"v{i}" if i % 10 == 3 and i < 80 else None) for i in range(100)]
    rows += [("small", 1, "a"), ("small", 2, "b"), ("small", 3, None), ("none", 1, None)] + [("hole", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, v string").repartition(4)
    got = running(df, ["k"], [F.col("i")], [F.col("i").cast("double")], before={"n": ("count", None)},
                  group={"newest": ("last", F.col("v"))}, rows_per_task=rows_per_task)
    assert got.count() == len(rows)
    assert {tuple(r) for r in got.select("k", "newest").distinct().collect()} == {
        ("big", "v73"), ("small", "b"), ("none", None), ("hole", None)}


def test_positions_on_text_order(skewed):
    df = skewed.withColumn("name", F.concat(F.lit("SYN_PATIENT_"), F.lpad("i", 6, "0")))
    got = positions(df, ["k"], [F.col("name").desc()], [-c for c in sort_cuts(df, ["name"])],
                    "p", total="n", rows_per_task=10)
    want = df.withColumn("q", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("name"))) - 1)
    assert got.join(want, "i").filter("p != q").count() == 0
    assert got.count() == 1500


def test_first_rows_limits_before_the_shuffle(skewed):
    out = first_rows(skewed, ["k"], [F.col("d"), F.col("i")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("rows_per_task", [5, 10_000])
def test_exact_quantiles(skewed, rows_per_task):
    df = skewed.withColumn("v", F.when(F.col("i") % 9 > 0, F.round("v", 1)))
    got = exact_quantiles(df, ["k"], "v", {"q1": .25, "q2": .5, "q3": .75},
                          rows_per_task=rows_per_task).toPandas().set_index("k").sort_index()
    want = df.toPandas().groupby("k")["v"].quantile([.25, .5, .75]).unstack()
    pd.testing.assert_frame_equal(got, want.set_axis(["q1", "q2", "q3"], axis=1), check_names=False)
