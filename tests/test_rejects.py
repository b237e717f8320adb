"""Bad records go to a table with reasons, good ones go on."""

import pytest

from helpers import SPEC, day
from visitloom.operators import quality as qu
from visitloom.sources import readers
from visitloom.spec import DataError

CSV = """ Patient_ID ,visit_date,hba1c,sex
A,2020-01-01,5.5,F
B,2020-13-45,5.5,F
 NaN ,2020-01-02,,M
C,2020-01-03,high,M
D,2020-01-04
E,2020-01-05,5,F,extra
 F , 2020-01-06 ,nan,none
"""


def test_csv_lines(spark, tmp_path):
    (tmp_path / "v.csv").write_text(CSV)
    got = readers.read_csv_with_rejects(spark, str(tmp_path / "v.csv"), SPEC)
    rows = {r.patient_id: r for r in got.rows.collect()}
    assert set(rows) == {"A", "C", "F"} and rows["C"].hba1c is None and rows["F"].sex is None
    assert rows["F"].visit_date.isoformat() == "2020-01-06"
    bad = {r.record.split(",")[0].strip(): (r.reasons, r.file) for r in got.rejects.collect()}
    assert {k: v[0] for k, v in bad.items()} == {"B": ["unreadable_date"], "NaN": ["empty_id"], "D": ["malformed"],
                                                "E": ["malformed"]}
    assert all(f.endswith("v.csv") for _, f in bad.values())
    strict = readers.read_csv_with_rejects(spark, str(tmp_path / "v.csv"), SPEC, numbers=True)
    assert ["unreadable_number:hba1c"] in [r.reasons for r in strict.rejects.collect()]
    assert strict.rows.count() == 2


def test_csv_edges(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("patient_id,visit_date\n")
    got = readers.read_csv_with_rejects(spark, str(tmp_path / "empty.csv"), SPEC)
    assert got.rows.count() == got.rejects.count() == 0
    (tmp_path / "none.csv").write_text("visit_date,x\n2020-01-01,1\n")
    with pytest.raises(DataError):
        readers.read_csv_with_rejects(spark, str(tmp_path / "none.csv"), SPEC)


DOCUMENTS = [
    ("ok", '{"patient_id": "A", "visits": [{"visit_date": "2020-01-01", "hba1c": 5.5}, {"visit_date": "2020-02-01"}]}', []),
    ("list", '[{"visit_date": "2020-01-01"}]', []),
    ("cut", '{"patient_id": "B", "visits": [{"visit_date"', ["no_visits"]),
    ("text", "not json", ["no_visits"]), ("null", None, ["no_visits"]), ("none", '{"patient_id": "B", "visits": []}', ["no_visits"]),
    ("undated", '{"patient_id": "C", "visits": [{"visit_date": "2020-01-01"}, {"hba1c": 5}]}', ["undated"]),
    ("future", '{"patient_id": "D", "visits": [{"visit_date": "soon", " Target ": null}]}', ["undated", "forbidden"]),
    (" ", '{"visits": [{"visit_date": "2020-01-01"}]}', ["nobody"])]


def test_documents(spark):
    docs = spark.createDataFrame([d[:2] for d in DOCUMENTS], "name string, value string")
    got = readers.split_trajectories(docs, "value", SPEC, entity_column="name", keep=("name",))
    assert {r.name: r.reasons for r in got.rejects.collect()} == {n: why for n, _, why in DOCUMENTS if why}
    assert sorted((r.patient_id, r.visit_date.isoformat(), r.hba1c) for r in got.rows.collect()) == [
        ("A", "2020-01-01", 5.5), ("A", "2020-02-01", None), ("list", "2020-01-01", None)]
    with pytest.raises(DataError, match="4 documents are not JSON"):
        readers.parse_trajectories(docs, "value", SPEC, entity_column="name")


def test_every_code_of_the_findings(spark):
    rows = [("A", "2020-01-02", 1, 0, "yes", 1), ("A", "2020-01-01", 0, 0, "perhaps", 2), ("A", "2020-01-01", 3, 0, "no", 3),
            (" nan ", "2020-01-01", None, 0, None, 4), (None, "never", 0, 0, "YES", 5), ("B", None, 0, 0, "?", 6)]
    df = spark.createDataFrame(rows, "patient_id string, visit_date string, target int, outcome int, "
                                     "hypertension_diagnosis string, arrival int")
    got = {(r.level, r.code): (r.n, r.details) for r in qu.findings(
        df, SPEC, expected=("hba1c", "target"), ordinal="arrival").collect()}
    assert got == {
        ("warning", "MISSING_EXPECTED_COL"): (1, "hba1c"), ("warning", "LEAKAGE_CANDIDATE_COLUMNS"): (2, "target,outcome"),
        ("error", "EMPTY_PATIENT_ID"): (2, ""), ("error", "INVALID_VISIT_DATE"): (2, ""),
        ("error", "DUPLICATE_PATIENT_DATE"): (2, ""), ("warning", "NON_CHRONOLOGICAL_ORDER"): (1, "A"),
        ("error", "NON_BINARY_TARGET"): (1, "3"), ("error", "INCONSISTENT_TARGET"): (1, "A"),
        ("warning", "INVALID_BINARY_CATEGORICAL"): (2, "hypertension_diagnosis")}
    bare = {r.code: r.details for r in qu.findings(df.select("target"), SPEC).collect()}
    assert bare == {"MISSING_REQUIRED_COL": bare["MISSING_REQUIRED_COL"], "NON_BINARY_TARGET": "3",
                    "LEAKAGE_CANDIDATE_COLUMNS": "target"}
    clean = spark.createDataFrame([("A", day(1)), ("B", day(1))], "patient_id string, visit_date date")
    assert qu.findings(clean, SPEC).count() == 0 and qu.passed(qu.findings(clean.limit(0), SPEC))


def test_many_offenders_leave_a_sample(spark):
    df = spark.range(5000).selectExpr("concat('P', id % 2500) AS patient_id", "date '2020-01-01' AS visit_date",
                                      "id < 2500 AS late", "cast(id AS string) AS t").withColumnRenamed("t", "target2")
    df = df.selectExpr("patient_id", "visit_date", "cast(late AS int) + 1 AS target")
    got = {r.code: (r.n, r.details) for r in qu.findings(df, SPEC).collect()}
    assert got["INCONSISTENT_TARGET"] == (2500, ",".join(sorted(f"P{i}" for i in range(2500))[:10]))
    assert got["NON_BINARY_TARGET"] == (1, "2") and got["DUPLICATE_PATIENT_DATE"] == (5000, "")
