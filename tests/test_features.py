"""Wide rows, sequences and preprocessing against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, as_dict, day, history, timeline, without_future
from visitloom.operators import guards, preprocess as pp, sequence as se, wide as wi
from visitloom.spec import MISSING_LABEL, UNKNOWN_LABEL, DataError, LeakageError


@pytest.fixture(scope="module")
def obs(spark):
    rows = history(spark, "A", 5, base=5.0) + history(spark, "B", 1, base=6.0)
    rows += [("C", 0, False, 4.0, 0), ("C", 90, False, None, 0), ("C", 180, False, 7.0, 0)]
    return without_future(timeline(spark, rows))


def test_waves_are_the_oldest_visits(obs):
    w = {r.patient_id: r for r in wi.wide_features(obs, SPEC).collect()}
    assert [round(w["A"][f"hba1c_w{k}"], 2) for k in (1, 2, 3, 4)] == [5.0, 5.05, 5.1, 5.15]
    assert w["B"].hba1c_w2 is None and w["C"].hba1c_w2 is None and w["C"].hba1c_w3 == 7.0
    assert w["A"].n_obs_visits == 5


def test_summaries(obs):
    w = {r.patient_id: r for r in wi.wide_features(obs.repartition(4), SPEC).collect()}
    a, b, c = w["A"], w["B"], w["C"]
    assert math.isclose(a.hba1c_slope, 0.05) and math.isclose(a.hba1c_delta, 0.2)
    assert (b.hba1c_latest, b.hba1c_std, b.hba1c_delta, b.hba1c_slope) == (6.0, None, None, None)
    # the index counts the visit without a value: points (0, 4) and (2, 7)
    assert math.isclose(c.hba1c_slope, 1.5) and c.hba1c_mean == 5.5 and math.isclose(c.hba1c_std, math.sqrt(4.5))
    assert w["A"].heart_rate_latest is None and w["A"].smoking_status_latest is None   # absent columns


def test_latest_category_skips_missing(spark, obs):
    df = obs.withColumn("sex", F.when(F.col("visit_date") == F.lit(day(360)), " None ").otherwise(F.col("sex")))
    assert as_dict(wi.wide_features(df, SPEC), "patient_id", "sex_latest")["A"] == "F"


@pytest.mark.parametrize("rows_per_task", [2, 3])
def test_large_entities_give_the_same_row(obs, rows_per_task):
    a = sorted(wi.wide_features(obs, SPEC, bounded=True).collect())
    b = sorted(wi.wide_features(obs, SPEC, rows_per_task=rows_per_task).collect())
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or math.isclose(u, v, rel_tol=1e-12)


@pytest.mark.parametrize("kw", [{}, {"bounded": True}, {"rows_per_task": 2}])
def test_wide_rows_are_aggregated_by_hash(obs, kw):
    hole = F.col("visit_date").isin(day(90), day(360)) | (F.col("patient_id") == "B")
    wide = wi.wide_features(obs.withColumn("sex", F.when(hole, " none ").otherwise(F.col("sex"))), SPEC, **kw)
    assert as_dict(wide, "patient_id", "sex_latest") == {"A": "F", "B": None, "C": "M"}
    if not kw.get("rows_per_task"):
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_catalogue_covers_every_column(obs):
    names = [f.column for f in wi.catalogue(SPEC)]
    assert names != [] and set(names) == set(wi.wide_features(obs, SPEC).columns) - {"patient_id"}
    assert len(names) == 117
    one = next(f for f in wi.catalogue(SPEC) if f.column == "hba1c_w3")
    assert (one.source, one.wave, one.kind) == ("hba1c", 3, "numeric_wave")


def test_leakage_is_refused(spark, obs):
    with pytest.raises(LeakageError):
        wi.wide_features(obs.withColumn("target", F.lit(1)), SPEC)
    with pytest.raises(LeakageError):
        se.visit_vectors(obs.withColumn("outcome", F.lit(1)), SPEC, {})
    extra = obs.withColumn("future_HbA1c_max", F.lit(1)).withColumn("post_outcome", F.lit(1))
    assert "future_HbA1c_max" not in guards.safe_columns(extra, SPEC)
    assert set(guards.select_safe(extra, SPEC).columns) == set(obs.columns)
    assert guards.clean_missing(spark.createDataFrame([(" NaN ",), (" x",)], "s string"), ["s"]).collect()[0].s is None


def test_labels_follow_entities(spark, obs):
    w = wi.wide_features(obs, SPEC)
    labels = spark.createDataFrame([("C", 1), ("A", 0), ("B", 1)], "patient_id string, target int")
    got = as_dict(wi.attach_targets(w.orderBy(F.desc("patient_id")), labels, SPEC), "patient_id", "target")
    assert got == {"A": 0, "B": 1, "C": 1}
    with pytest.raises(DataError):
        wi.attach_targets(w, labels.filter("patient_id <> 'B'"), SPEC)


def test_sequence_invariants(spark, obs):
    vocab = se.collect_vocabulary(se.vocabulary(obs, SPEC))
    assert vocab["sex"] == [MISSING_LABEL, UNKNOWN_LABEL, "F", "M"]
    assert vocab["smoking_status"] == [MISSING_LABEL, UNKNOWN_LABEL]
    names = se.layout(obs, SPEC, vocab)
    assert names == ["hba1c", "bmi", "sex__<MISSING>", "sex__<UNK>", "sex__F", "sex__M"]
    rows = {r.patient_id: r for r in se.sequences(obs, SPEC, vocab).collect()}
    for r in rows.values():
        assert len(r.X) == 4 and sum(r["mask"]) == r.length and r["mask"] == sorted(r["mask"], reverse=True)
        for step, real in zip(r.X, r["mask"]):
            assert sum(step[2:]) == real
            assert real or set(step) == {0.0}
    assert [round(s[0], 2) for s in rows["A"].X] == [5.05, 5.1, 5.15, 5.2]      # the most recent four
    assert rows["C"].X[1][0] is None and rows["C"].length == 3


def test_unseen_and_missing_labels(spark, obs):
    vocab = se.collect_vocabulary(se.vocabulary(obs.filter("sex = 'M'"), SPEC))
    df = obs.withColumn("sex", F.when(F.col("patient_id") == "B", "nan").otherwise(F.col("sex")))
    long = se.unpack(se.sequences(df, SPEC, vocab), SPEC, se.layout(df, SPEC, vocab)).filter("is_real = 1 AND value = 1.0")
    hot = {(r.patient_id, r.step): r.feature for r in long.filter("feature LIKE 'sex%'").collect()}
    assert hot[("B", 0)] == "sex__<MISSING>" and "sex__<UNK>" in hot.values()


def test_fit_on_train_only(spark):
    train = spark.createDataFrame([(1, 1.0, "M"), (2, 3.0, "F"), (3, None, None), (4, 8.0, "M")], "id int, x double, s string")
    p = pp.Preprocessor.fit(train, ["x", "absent"], ["s"])
    assert p.numeric[0][:3] == ("x", 3.0, 4.0) and math.isclose(p.numeric[0][3], math.sqrt(13))
    assert p.numeric[1] == ("absent", 0.0, 0.0, 1.0)
    assert p.output_names == ["x", "absent", "s__<MISSING>", "s__F", "s__M"]
    far = spark.createDataFrame([(1, 1000.0, "Z"), (2, None, " M ")], "id int, x double, s string")
    out = {r.id: r for r in p.transform(far, ["id"]).collect()}
    assert math.isclose(out[1].x, 996 / math.sqrt(13)) and math.isclose(out[2].x, -1 / math.sqrt(13))
    assert [out[1]["s__F"], out[1]["s__M"], out[2]["s__M"]] == [0.0, 0.0, 1.0]


def test_constant_column_scales_by_one(spark):
    p = pp.Preprocessor.fit(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"], [])
    assert p.numeric == (("x", 2.0, 2.0, 1.0),)


def test_preprocessor_round_trip(spark, tmp_path, obs):
    p = pp.Preprocessor.fit(obs, ["hba1c", "bmi"], ["sex"])
    p.write(spark, str(tmp_path / "p"))
    assert pp.Preprocessor.read(spark, str(tmp_path / "p")) == p


def test_sequence_scaling_ignores_padding(spark, obs):
    vocab = se.collect_vocabulary(se.vocabulary(obs, SPEC))
    names = se.layout(obs, SPEC, vocab)
    x = se.sequences(obs, SPEC, vocab)
    stats = pp.fit_sequence_stats(x, SPEC, names)
    values = [5.05, 5.1, 5.15, 5.2, 6.0, 4.0, 7.0]
    assert math.isclose(as_dict(stats, "feature", "mean")["hba1c"], sum(values) / 7)
    done = se.unpack(pp.apply_sequence_stats(x, stats, names), SPEC, names)
    assert done.filter("value IS NULL OR (is_real = 0 AND value <> 0)").count() == 0
    assert abs(done.filter("is_real = 1 AND feature = 'bmi'").agg(F.avg("value")).first()[0]) < 1e-9
