"""Quantiles of columns by bracketing agree with numpy, and shuffle few values."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import GroupedData, functions as F

from visitloom.functions import number_or_null
from visitloom.operators import preprocess as pp, quantiles as qt

PROBS = {"p0": 0.0, "p25": .25, "median": .5, "p90": .9, "p100": 1.0}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 50), float(rng.choice([1, 1, 1, 2, 9])), 7.0, None,
             None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(rng.randrange(5)),
             rng.random() if i % 3 else 0.5, float("inf") if i % 7 == 0 else -i / 3) for i in range(4000)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, `f.g` double, h double"
                                 ).repartition(5).cache()


@pytest.mark.parametrize("size", [{}, {"accuracy": 5, "enough": 4}, {"accuracy": 50, "enough": 1}])
def test_columns_agree_with_numpy(table, size):
    got = {r["column"]: r for r in qt.column_quantiles(table, table.columns, PROBS, **size).collect()}
    data = table.toPandas()
    for name in table.columns:
        v, r = data[name].dropna().to_numpy(), got[name]
        assert (r["n_rows"], r["count"]) == (4000, len(v))
        if not len(v):
            assert [r[p] for p in PROBS] == [None] * 5 and r["mean"] is None
            continue
        with np.errstate(invalid="ignore"):
            want = np.quantile(v, list(PROBS.values()))
        for p, w in zip(PROBS, want):
            assert math.isclose(r[p], w, rel_tol=1e-12) or (r[p] == math.inf and not w < math.inf), (name, p)
        if np.isfinite(v).all():
            assert math.isclose(r["mean"], v.mean(), abs_tol=1e-9) and math.isclose(r["std"], v.std(ddof=1), abs_tol=1e-9)


def test_few_values_are_shuffled(spark, monkeypatch):
    """At most one cell in twenty reaches a shuffle, however many columns there are."""
    rows = spark.range(60_000).select(*[F.rand(i).alias(f"c{i}") for i in range(6)]).cache()
    seen, real = [], qt.bracketed_values

    def watched(df, x, brackets):
        out = real(df, x, brackets)
        seen.append(out.count())        # values that differ, as these do, are rows of the exchange
        return out

    monkeypatch.setattr(qt, "bracketed_values", watched)
    qt.column_quantiles(rows, rows.columns, {"p25": .25, "median": .5, "p75": .75}).collect()
    assert 0 < sum(seen) <= 0.05 * 6 * 60_000


def test_columns_are_aggregated_as_rows(spark, monkeypatch):
    """The aggregates of a pass do not grow with the columns; more columns than a part has give the same answers."""
    rows = spark.range(400).select(*[(F.col("id") * (i % 7 + 1) % 401 + i).cast("double").alias(f"c{i}") for i in range(130)]).cache()
    sizes, real = [], GroupedData.agg

    def watched(self, *exprs):
        sizes.append(len(exprs))
        return real(self, *exprs)

    monkeypatch.setattr(GroupedData, "agg", watched)
    got = {r["column"]: r for r in qt.column_quantiles(rows, rows.columns, {"p25": .25, "median": .5}).collect()}
    assert max(sizes) < 10
    data = rows.toPandas()
    for name in rows.columns:
        v, r = data[name].to_numpy(), got[name]
        assert (r["n_rows"], r["count"], r["p25"], r["median"]) == (400, 400, np.quantile(v, .25), np.quantile(v, .5))
        assert math.isclose(r["std"], v.std(ddof=1), rel_tol=1e-9) and (r["min"], r["max"]) == (v.min(), v.max())


def test_empty_and_absent(spark):
    empty = spark.createDataFrame([], "x double")
    assert qt.column_quantiles(empty, ["x"], PROBS).first()["count"] == 0
    got = {r["feature"]: tuple(r)[1:] for r in pp.fit_numeric(empty, ["x", "absent"]).collect()}
    assert got == {"x": (0.0, 0.0, 1.0), "absent": (0.0, 0.0, 1.0)}
    assert pp.fit_numeric(empty, []).count() == 0


def test_undefined_values_are_no_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    assert df.filter(number_or_null(F.col("x")).isNotNull()).count() == 2
    assert tuple(pp.fit_numeric(df, ["x"]).first())[:3] == ("x", 2.5, 2.5)
