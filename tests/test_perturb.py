"""Perturbations depend on identities only and keep what they promise to keep."""

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, day, history, timeline, without_future
from visitloom.operators import perturb as pe
from visitloom.spec import Condition


@pytest.fixture(scope="module")
def obs(spark):
    rows = [r for p in "ABCDEF" for r in history(spark, p, 4)] + history(spark, "G", 1)
    return without_future(timeline(spark, rows)).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def shuffled(df):
    return df.orderBy(F.rand(9)).repartition(5)


@pytest.mark.parametrize("change", [
    lambda d: pe.remove_measurements(d, SPEC, 0.4),
    lambda d: pe.remove_visits(d, SPEC, 0.5),
    lambda d: pe.jitter_visit_timing(d, SPEC, 40),
    lambda d: pe.truncate_to_recent_visits(d, SPEC, 2)])
def test_invariance(obs, change):
    whole = rows(change(obs))
    assert whole == rows(change(shuffled(obs)))
    assert [r for r in whole if r[0] == "B"] == rows(change(obs.filter("patient_id = 'B'")))
    assert change(obs).columns == obs.columns


def test_remove_measurements(obs):
    assert rows(pe.remove_measurements(obs, SPEC, 0.0)) == rows(obs)
    gone = pe.remove_measurements(obs, SPEC, 1.0, columns=["hba1c"])
    assert gone.filter("hba1c IS NOT NULL OR bmi IS NULL").count() == 0
    half = pe.remove_measurements(obs, SPEC, 0.5)
    counts = {r.feature: r.cells_blanked for r in pe.blanked_cells(obs, SPEC, 0.5).collect()}
    assert counts == {c: half.filter(F.col(c).isNull()).count() for c in ("hba1c", "bmi", "sex")}
    assert 0 < counts["hba1c"] < 25
    with pytest.raises(ValueError):
        pe.remove_measurements(obs, SPEC, 1.5)


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_remove_visits(obs, rows_per_task):
    n = {r.patient_id: r["count"] for r in pe.remove_visits(
        obs, SPEC, 0.5, rows_per_task=rows_per_task).groupBy("patient_id").count().collect()}
    assert n == {**dict.fromkeys("ABCDEF", 2), "G": 1}
    kept = pe.remove_visits(obs, SPEC, 1.0, min_visits_kept=3).groupBy("patient_id").count()
    assert {r.patient_id: r["count"] for r in kept.collect()} == {**dict.fromkeys("ABCDEF", 3), "G": 1}


def test_truncate(obs):
    out = pe.truncate_to_recent_visits(obs, SPEC, 2)
    assert {r.visit_date for r in out.filter("patient_id = 'A'").collect()} == {day(180), day(270)}
    assert rows(pe.thin_followup(obs, SPEC, 2, seed=1)) == rows(out)


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_jitter_keeps_order_and_span(obs, rows_per_task):
    out = pe.jitter_visit_timing(obs, SPEC, 200, rows_per_task=rows_per_task)
    assert out.count() == obs.count()
    for p in "ABCDEF":
        dates = [r.visit_date for r in out.filter(F.col("patient_id") == p).orderBy("visit_id").collect()]
        assert dates == sorted(dates) and dates[0] >= day(0) and dates[-1] <= day(270)
    assert rows(out) != rows(obs)
    assert rows(pe.jitter_visit_timing(obs, SPEC, 0)) == rows(obs)


def test_record(obs):
    r = pe.condition_record(obs, pe.remove_visits(obs, SPEC, 0.5), SPEC, Condition("remove_visits", 0.5, {"seed": 42})).first()
    assert (r.entities_before, r.entities_after, r.visits_before, r.visits_after) == (7, 7, 25, 13)
    assert r.params == {"seed": "42"}
