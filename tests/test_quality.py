"""Validation findings and profiles."""

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, as_dict, history, timeline, without_future
from visitloom.operators import profile as pr, quality as qu


@pytest.fixture(scope="module")
def clean(spark):
    rows = history(spark, "A", 3) + history(spark, "B", 4)
    return without_future(timeline(spark, rows)).withColumn("metformin_use", F.lit("Yes"))


def codes(df):
    return {r.code: (r.level, r.n) for r in df.collect()}


def test_clean_table_passes(clean):
    found = qu.findings(clean, SPEC, ordinal="visit_id")
    assert codes(found) == {} and qu.passed(found)


def test_every_finding(spark, clean):
    bad = (clean.withColumn("patient_id", F.when(F.col("visit_id") == 0, " NaN ").otherwise(F.col("patient_id")))
           .withColumn("visit_date", F.when(F.col("visit_id") == 1, "soon").when(F.col("visit_id") < 5, "2021-05-05")
                       .otherwise("2020-01-01"))
           .withColumn("metformin_use", F.when(F.col("visit_id") == 2, "maybe").otherwise(" NO "))
           .withColumn("target", F.when(F.col("visit_id") == 6, 3).otherwise((F.col("visit_id") % 2).cast("int"))))
    found = qu.findings(bad, SPEC, expected=("hba1c", "weight"), ordinal="visit_id")
    assert codes(found) == {
        "EMPTY_PATIENT_ID": ("error", 1), "INVALID_VISIT_DATE": ("error", 1),
        "DUPLICATE_PATIENT_DATE": ("error", 4), "NON_CHRONOLOGICAL_ORDER": ("warning", 1),
        "MISSING_EXPECTED_COL": ("warning", 1), "NON_BINARY_TARGET": ("error", 1),
        "INCONSISTENT_TARGET": ("error", 2), "INVALID_BINARY_CATEGORICAL": ("warning", 1),
        "LEAKAGE_CANDIDATE_COLUMNS": ("warning", 1)}
    assert not qu.passed(found)
    lenient = codes(qu.findings(bad, SPEC, allow_duplicates=True, target_is_error=False))
    assert lenient["DUPLICATE_PATIENT_DATE"][0] == lenient["INCONSISTENT_TARGET"][0] == "warning"
    assert codes(qu.findings(bad.drop("patient_id"), SPEC))["MISSING_REQUIRED_COL"] == ("error", 1)


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_order_of_arrival(spark, rows_per_task):
    df = spark.createDataFrame([("A", "2020-01-01", 0), ("A", "2020-01-01", 1), ("A", "2020-03-01", 2),
                                ("B", "2020-05-01", 3), ("B", "2020-06-01", 4), ("B", "2020-04-01", 5)],
                               "patient_id string, visit_date string, n int")
    df = df.withColumn("visit_date", F.to_date("visit_date"))
    got = qu.unordered_entities(df, SPEC, "n", rows_per_task=rows_per_task).collect()
    assert [r.patient_id for r in got] == ["B"]


def test_profiles(clean):
    df = clean.withColumn("hba1c", F.when(F.col("visit_id") != 3, F.col("hba1c"))).withColumn(
        "sex", F.when(F.col("visit_id") == 0, "None").otherwise(F.col("sex"))).withColumn(
        "target", F.when(F.col("patient_id") == "A", 1))
    c = pr.dataset_counts(df, SPEC).first()
    assert (c.n_rows, c.n_entities, c.visits_min, c.visits_max, c.visits_median, c.visits_mean) == (7, 2, 3, 4, 3.5, 3.5)
    n = {r.column: r for r in pr.numeric_summary(df, SPEC).collect()}
    assert set(n) == {"hba1c", "bmi"} and (n["hba1c"]["count"], n["hba1c"].missing) == (6, 1)
    want = df.toPandas()["hba1c"].describe()
    assert [n["hba1c"][k] for k in ("mean", "std", "p25", "median", "p75")] == [
        round(want[k], 4) for k in ("mean", "std", "25%", "50%", "75%")]
    s = {r.column: r for r in pr.categorical_summary(df, SPEC).collect()}["sex"]
    assert (s.n_unique, s.missing) == (2, 1)
    assert as_dict(pr.missingness(df), "column", "n_missing") == {"hba1c": 1, "target": 4}
    t = pr.target_distribution(df, SPEC).first()
    assert (t.n_positive, t.n_negative, t.n_unknown, t.positive_rate) == (1, 0, 1, 1.0)
    m = pr.dataset_metadata(df, SPEC).first()
    assert (m.n_entities, m.n_visits, m.missing_rate) == (2, 7, round(1 / 14, 4))
    assert pr.duplicate_count(df.unionByName(df), SPEC).first()[0] == 7
