"""The partitioned visit store, and scores for chosen visits."""

import os
from dataclasses import replace

import pytest

from checks.queries import FixedModel
from helpers import SPEC, day, history, timeline, without_future
from visitloom.operators import visit_table as vt, wide as wi
from visitloom.plans import models as mo, training as tr
from visitloom.plans.selection import judge_requests, score_selection
from visitloom.sources.visit_store import VisitStore, versions
from visitloom.spec import DataError

COLUMNS = "visit_id long, patient_id string, visit_date date, hba1c double, sex string"


@pytest.fixture
def visits(spark):
    return spark.createDataFrame([(i, f"P{i % 9}", day(i), i / 10, "F") for i in range(200)], COLUMNS)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "seq long, op string, patient_id string, visit_id long, fields map<string,string>")


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names
            if f.endswith(".parquet")}


def test_changes_touch_their_buckets_only(spark, visits, tmp_path):
    root = str(tmp_path / "s")
    one = VisitStore.create(root, visits, SPEC, buckets=8)
    assert sorted(map(tuple, one.read().collect())) == sorted(map(tuple, visits.collect()))
    before = files(root + "/data")
    changes = log(spark, (1, "update", "P3", 3, {"hba1c": "9.5"}), (2, "delete", "P4", 4, {}), (3, "update", "P1", 5, {}),
                  (4, "add", "PX", 1000, {"visit_date": "2021-01-01"}))
    two, rejected = one.apply(changes)
    assert [(r.seq, r.reason) for r in rejected.collect()] == [(3, "not_owner")]
    touched = one.touched(changes)
    assert 0 < len(touched) <= 4
    after = files(root + "/data")
    assert {k: v for k, v in after.items() if k in before} == before        # nothing is rewritten in place
    new = {int(k.split("bucket=")[1].split("/")[0]) for k in set(after) - set(before)}
    assert new <= set(touched)
    read = one.read(touched).inputFiles()                                    # and other buckets are not read
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= set(touched)
    want = vt.apply_changes(visits, changes, SPEC).visits
    assert sorted(map(str, two.read().collect())) == sorted(map(str, want.select(*two.schema.names).collect()))
    old = VisitStore.open(spark, root, SPEC, 1)
    assert old.read().count() == 200 and VisitStore.open(spark, root, SPEC).version == 2


def test_half_written_versions_are_not_seen(spark, visits, tmp_path):
    root = str(tmp_path / "s")
    one = VisitStore.create(root, visits, SPEC, buckets=4)
    two, _ = one.apply(log(spark, (1, "delete", "P4", 4, {})))
    os.remove(f"{root}/versions/2/_SUCCESS")        # as if the writer had died before the end
    assert versions(spark, root) == [1] and VisitStore.open(spark, root, SPEC).read().count() == 200
    with pytest.raises(Exception, match="(?i)exist"):
        one.apply(log(spark, (1, "delete", "P4", 4, {}), (2, "delete", "P5", 5, {})))       # another writer of version 2
    assert two.read().count() == 199        # whose files are not those of the first
    with pytest.raises(DataError):
        VisitStore.open(spark, root, SPEC, 2)
    with pytest.raises(DataError):
        VisitStore.create(root, visits, SPEC)


def test_empty_buckets_and_old_versions(spark, visits, tmp_path):
    root = str(tmp_path / "s")
    few = visits.filter("visit_id < 3")
    store = VisitStore.create(root, few, SPEC, buckets=32)
    same, rejected = store.apply(log(spark))
    assert same.version == 1 and rejected.count() == 0
    for i, who in enumerate(("P0", "P1", "P2")):
        store, _ = store.apply(log(spark, (1, "delete", who, i, {})))
    assert store.version == 4 and store.read().count() == 0 and store.read().columns == few.columns
    assert store.forget_before(4) > 0 and versions(spark, root) == [4]
    assert VisitStore.open(spark, root, SPEC).read().count() == 0
    with pytest.raises(DataError):
        VisitStore.create(str(tmp_path / "t"), few.unionByName(few), SPEC)


def test_requests_get_one_status(spark):
    visits = without_future(timeline(spark, history(spark, "A", n=5) + history(spark, "B", n=3)))
    patients = spark.createDataFrame([("A",), ("B",), ("C",), (" ",)], "patient_id string")
    ids = {r.patient_id: [] for r in patients.collect()}
    for r in visits.orderBy("visit_date").collect():
        ids[r.patient_id].append(r.visit_id)
    a, b = ids["A"], ids["B"]
    asked = spark.createDataFrame([
        (1, " A ", [a[2], a[0]]), (2, "A", [b[0]]), (3, "nobody", [a[0]]), (4, "A", []), (5, "A", None), (6, "A", a),
        (7, "A", [a[0], 999]), (8, "C", [a[0]]), (9, "A", [a[1], a[1]]), (10, "", [a[0]]), (11, "nobody", []), (12, None, [a[0]]),
        (13, "B", b)],
        "request int, patient_id string, visit_ids array<long>")
    verdicts, chosen = judge_requests(asked, patients, visits, SPEC, 4)
    assert {r.request: r.status for r in verdicts.collect()} == {
        1: "ok", 2: "not_owner", 3: "unknown_patient", 4: "empty_selection", 5: "empty_selection", 6: "too_many",
        7: "unknown_visit", 8: "not_owner", 9: "ok", 10: "unknown_patient", 11: "empty_selection", 12: "unknown_patient",
        13: "ok"}
    assert chosen.groupBy("request").count().orderBy("request").collect() == [(1, 2), (9, 2), (13, 3)]

    shell = tr.fit_representation(wi.wide_features(visits, SPEC), SPEC, tr.WIDE, 4)
    art = replace(shell, model=mo.FittedModel("fixed", FixedModel(
        shell.preprocessor.output_names, 0.0, {"hba1c_latest": 2.0})))
    out = {r.request: r for r in score_selection(art, asked, patients, visits).collect()}
    assert len(out) == 13 and {k for k, r in out.items() if r.p is not None} == {1, 9, 13}
    assert out[1].visit_ids == [a[0], a[2]] and out[1].dates == [day(0), day(180)] and out[1].n_visits == 2
    assert out[6].visit_ids is None and 0 < out[13].p < 1 and out[13].prediction == int(out[13].p >= 0.5)
    whole = {r.patient_id: r.p for r in art.score(visits).collect()}
    assert out[13].p == pytest.approx(whole["B"])      # all visits of one patient: the score of the batch


def test_selection_knows_patients(spark):
    visits = without_future(timeline(spark, history(spark, "A", n=2)))
    vid = visits.first().visit_id
    wanted = spark.createDataFrame([("X", vid), ("A", vid)], "patient_id string, visit_id long")
    patients = spark.createDataFrame([("A",)], "patient_id string")
    got = vt.select_visits(wanted, visits, SPEC, 4, patients)
    assert {r.patient_id: r.status for r in got.collect()} == {"X": "unknown_patient", "A": "ok"}
    assert {r.status for r in vt.select_visits(wanted.limit(0), visits, SPEC, 4).collect()} == set()
