"""The visit table, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, as_dict, day, history, timeline
from visitloom.operators import visit_table as vt
from visitloom.sources import readers, sinks
from visitloom.spec import DataError, LeakageError, VisitSpec

PLAIN = VisitSpec()


@pytest.fixture()
def visits(spark):
    return spark.createDataFrame(
        [("A", 1, day(0), 5.0, "F"), ("A", 2, day(90), 5.5, "F"), ("B", 3, day(0), 6.0, "M")],
        "patient_id string, visit_id long, visit_date date, hba1c double, sex string")


def test_register_is_idempotent(spark):
    known = spark.createDataFrame([(7, "A")], "id long, patient_id string")
    incoming = spark.createDataFrame([(" A ",), ("b",), ("B",), ("b ",), ("",), (None,)], "patient_id string")
    once = vt.register_patients(known, incoming, SPEC)
    assert as_dict(once, "patient_id", "id") == {"A": 7, "B": 8, "b": 9}
    assert as_dict(vt.register_patients(once, incoming, SPEC), "patient_id", "id") == {"A": 7, "B": 8, "b": 9}
    assert vt.rejected_ids(incoming, SPEC).count() == 2


def test_changes(spark, visits):
    log = spark.createDataFrame([
        (1, "update", "A", 1, {"hba1c": "7.5", "sex": ""}), (2, "update", "A", 1, {"hba1c": "8.0"}),
        (3, "update", "B", 2, {"hba1c": "9.9"}), (4, "delete", "A", 3, {}), (5, "delete", "B", 3, {}),
        (6, "update", "B", 3, {"sex": "F"}), (7, "update", "A", 99, {"sex": "F"}),
        (8, "add", "C", 10, {"visit_date": "2021-01-01", "hba1c": "5.1"}), (9, "update", "C", 10, {"visit_date": " "}),
        (10, "add", "D", 1, {"hba1c": "1"})],
        "seq int, op string, patient_id string, visit_id long, fields map<string,string>")
    out = vt.apply_changes(visits, log, SPEC)
    got = {r.visit_id: (r.patient_id, r.hba1c, r.sex) for r in out.visits.collect()}
    assert got == {1: ("A", 8.0, None), 2: ("A", 5.5, "F"), 10: ("C", 5.1, None)}
    assert out.visits.filter("visit_id = 10").first().visit_date.isoformat() == "2021-01-01"
    assert as_dict(out.rejected, "seq", "reason") == {
        3: "not_owner", 4: "not_owner", 6: "unknown_visit", 7: "unknown_visit", 10: "duplicate_visit"}


def test_history_and_selection(spark, visits):
    patients = spark.createDataFrame([("A",)], "patient_id string")
    assert as_dict(vt.visit_history(visits, patients, SPEC), "visit_id", "visit_number") == {1: 1, 2: 2}
    wanted = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("B", 1), ("C", 50), ("D", 3)],
                                   "patient_id string, visit_id long")
    assert as_dict(vt.select_visits(wanted, visits, SPEC, 4), "patient_id", "status") == {
        "A": "ok", "B": "not_owner", "C": "unknown_visit", "D": "not_owner"}
    assert as_dict(vt.select_visits(wanted.limit(2), visits, SPEC, 1), "patient_id", "status") == {"A": "too_many"}


def csv(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = csv(tmp_path / "a.csv", " Patient_ID ,VISIT_DATE,hba1c,sex,diabetes_diagnosis,visit_number,target\n"
               " P1 ,2020-01-05,5.5, F ,1,1,0\nP2,2020-02-05,bad,nan,x,2.0,\n")
    df = readers.read_visits_csv(spark, path)
    rows = {r.patient_id: r for r in df.collect()}
    assert rows["P1"].visit_date.isoformat() == "2020-01-05" and rows["P1"].sex == "F"
    assert rows["P2"].hba1c is None and rows["P2"].sex is None and rows["P2"].diabetes_diagnosis is None
    assert (rows["P2"].visit_number, rows["P2"].target) == (2, None)
    full = readers.complete_layout(df, PLAIN)
    assert {*PLAIN.numeric, *PLAIN.categorical} <= set(full.columns)
    fmt = csv(tmp_path / "f.csv", "patient_id,visit_date\nA,05/01/2020\n")
    assert readers.read_visits_csv(spark, fmt, date_format="dd/MM/yyyy").first().visit_date.isoformat() == "2020-01-05"


@pytest.mark.parametrize("text", [
    "patient_id,visit_date\n", "patient_id,hba1c\nA,1\n", "patient_id,visit_date\nNone,2020-01-01\n",
    "patient_id,visit_date\nA,tomorrow\n", "patient_id,visit_date\nA,\n"])
def test_bad_csv(spark, tmp_path, text):
    with pytest.raises(DataError):
        readers.read_visits_csv(spark, csv(tmp_path / "b.csv", text))


def test_strict_expected_columns(spark, tmp_path):
    path = csv(tmp_path / "c.csv", "patient_id,visit_date\nA,2020-01-01\n")
    with pytest.raises(DataError):
        readers.read_visits_csv(spark, path, expected=("hba1c",), strict=True)


def test_trajectories(spark, tmp_path):
    visit = {"visit_date": "2020-01-01", "visit_number": 1, "hba1c": 5.6, "sex": " F ", "metformin_use": None}
    (tmp_path / "one.json").write_text("﻿" + json.dumps({"patient_id": "P1", "visits": [visit, {**visit, "hba1c": "x"}]}, indent=1))
    (tmp_path / "two.json").write_text(json.dumps([{**visit, "visit_date": "2019-05-05"}]))
    df = readers.read_trajectories(spark, str(tmp_path), PLAIN)
    got = sorted((r.patient_id, r.visit_date.isoformat(), r.hba1c, r.sex) for r in df.collect() if r.hba1c)
    assert got == [("P1", "2020-01-01", 5.6, "F"), ("two", "2019-05-05", 5.6, "F")]
    assert df.count() == 3 and "target" not in df.columns


@pytest.mark.parametrize("doc,error", [
    ('{"patient_id": "A"}', DataError), ('{"visits": []}', DataError), ("not json", DataError),
    ('[{"hba1c": 5}]', DataError), ('[{"visit_date": "2020-01-01", "target": 1}]', LeakageError),
    ('[{"visit_date": "2020-01-01", "target": null}]', LeakageError), ('[{"visit_date": "2020-01-01"}]', DataError),
    ('{"patient_id": " ", "visits": [{"visit_date": "2020-01-01"}]}', DataError)])
def test_bad_trajectories(spark, doc, error):
    with pytest.raises(error):
        readers.parse_trajectories(spark.createDataFrame([(doc,)], "value string"), "value", PLAIN)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_timeline_sink(spark, tmp_path, fmt):
    full = timeline(spark, history(spark, "A", 3, future=[(300, 7.0, 1)])).withColumn("target", F.lit(1))
    sinks.write_timeline(full, SPEC, str(tmp_path), fmt)
    obs = spark.read.format(fmt).option("header", True).load(str(tmp_path / "observations"))
    assert obs.count() == 3 and not {"target", "is_future_visit"} & set(obs.columns)
    meta = spark.read.json(str(tmp_path / "metadata")).first()
    assert (meta.n_entities, meta.n_visits, meta.prevalence) == (1, 4, 1.0)


def test_run_records(spark, tmp_path):
    row = ("1.0", "run_1", None, {"split": 42}, "d", None, ("baseline", None, {}), {"auroc": 0.7, "f1": None}, {}, "now")
    runs = spark.createDataFrame([row], sinks.RUN_SCHEMA)
    path = str(tmp_path / "runs")
    sinks.append_runs(runs, path)
    sinks.append_runs(runs.withColumn("run_id", F.lit("run_2")), path)
    assert sinks.read_runs(spark, path).count() == 2
    assert sinks.read_runs(spark, path).first().metrics == {"auroc": 0.7, "f1": None}
    for bad in (runs.withColumn("run_id", F.lit(" ")), runs.withColumn("schema_version", F.lit("2.0"))):
        with pytest.raises(DataError):
            sinks.append_runs(bad, path)
