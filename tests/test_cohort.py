"""Eligibility rules, the horizon, and what may reach observation data."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, as_dict, day, history, timeline
from visitloom.operators import cohort as co
from visitloom.operators.wide import wide_features
from visitloom.spec import CohortRules, DataError, LeakageError


def build(spark, rows, **rules):
    return co.future_outcome_cohort(timeline(spark, rows), SPEC, CohortRules(**rules))


def status(cohort):
    return as_dict(cohort.status, "patient_id", "status")


def test_first_failing_rule_wins(spark):
    rows = (history(spark, "few", 2, future=[(300, 7.0, 1)])
            + history(spark, "alone", 3)
            + history(spark, "prior", 3, base=6.5, future=[(300, 7.0, 0)])
            + history(spark, "prior_alone", 3, base=6.5)
            + history(spark, "late", 3, future=[(180 + 366, 9.0, 1)])
            + history(spark, "edge", 3, future=[(180 + 365, 9.0, 0)])
            + history(spark, "same_day", 3, future=[(180, 9.0, 1)])
            + history(spark, "negative", 3, future=[(200, 6.49, 0)]))
    c = build(spark, rows)
    assert status(c) == {
        "few": "too_few_visits", "alone": "no_followup", "prior": "prior_condition",
        "prior_alone": "no_followup", "late": "none_in_horizon", "edge": "eligible",
        "same_day": "no_followup", "negative": "eligible"}
    assert as_dict(c.targets, "patient_id", "target") == {"edge": 1, "negative": 0}
    n = c.counts().first()
    assert (n.input_entities, n.eligible, n.excluded_followup, n.positive_rate) == (8, 2, 4, 0.5)


def test_threshold_flag_and_null_measure(spark):
    rows = (history(spark, "at", 3, future=[(200, 6.5, 0)]) + history(spark, "below", 3, future=[(200, 6.4999, 0)])
            + history(spark, "flag", 3, future=[(200, None, 1)]) + history(spark, "null", 3, future=[(200, None, None)]))
    c = build(spark, rows)
    assert as_dict(c.targets, "patient_id", "target") == {"at": 1, "below": 0, "flag": 1, "null": 0}
    audit = {r.patient_id: r for r in c.audit.collect()}
    assert audit["flag"].max_measure is None and audit["flag"].any_flag == 1 and audit["null"].any_flag == 0
    assert audit["at"].cutoff == day(180) and audit["at"].horizon_end == day(545) and audit["at"].n_obs == 3


def test_keeps_last_visits_with_flag_but_first_by_position(spark):
    rows = history(spark, "A", 6, future=[(500, 5.0, 0)])
    kept = build(spark, rows).observations
    assert sorted(r.visit_date for r in kept.collect()) == [day(d) for d in (180, 270, 360, 450)]
    by_position = co.future_outcome_cohort(timeline(spark, rows).drop("is_future_visit"), SPEC)
    assert sorted(r.visit_date for r in by_position.observations.collect()) == [day(d) for d in (0, 90, 180, 270)]
    assert as_dict(by_position.audit, "patient_id", "n_in_horizon") == {"A": 3}


def test_optional_rules(spark):
    rows = history(spark, "prior", 3, base=7.0, future=[(200, 5.0, 0)]) + history(spark, "alone", 3)
    c = build(spark, rows, exclude_prior=False, require_followup=False)
    # without the follow-up rule an entity without future visits still cannot be labelled
    assert status(c) == {"prior": "eligible", "alone": "none_in_horizon"}


def test_future_values_never_reach_features(spark):
    rows = history(spark, "A", 3, base=5.8, future=[(366, 12.0, 1)])
    c = build(spark, rows, horizon_days=400)
    assert as_dict(c.targets, "patient_id", "target") == {"A": 1}
    assert "is_future_visit" not in c.observations.columns
    co.assert_no_leakage(c)
    w = wide_features(c.observations, SPEC, bounded=True).first().asDict()
    assert max(v for k, v in w.items() if k.startswith("hba1c") and v is not None) < 6.0
    bad = replace(c, audit=c.audit.withColumn("cutoff", F.date_sub("cutoff", 100)))
    with pytest.raises(LeakageError):
        co.assert_no_leakage(bad)


def test_text_flag_is_read(spark):
    rows = history(spark, "A", 3, future=[(200, 7.0, 0)])
    df = timeline(spark, rows).withColumn("is_future_visit", F.when(F.col("is_future_visit"), " TRUE").otherwise("no"))
    assert status(co.future_outcome_cohort(df, SPEC)) == {"A": "eligible"}


def test_prelabeled(spark):
    rows = history(spark, "a", 5) + history(spark, "b", 3) + history(spark, "c", 3) + history(spark, "d", 2)
    df = timeline(spark, rows).drop("is_future_visit").withColumn(
        "target", F.when(F.col("patient_id") == "a", 1).when(F.col("patient_id") == "c", (F.col("visit_id") % 2).cast("int")))
    with pytest.raises(DataError):
        co.prelabeled_cohort(df, SPEC)
    c = co.prelabeled_cohort(df, SPEC, CohortRules(inconsistent_is_error=False))
    assert status(c) == {"a": "eligible", "b": "no_target", "c": "inconsistent_target", "d": "too_few_visits"}
    assert sorted(r.visit_date for r in c.observations.collect()) == [day(d) for d in (0, 90, 180, 270)]
    assert "target" not in c.observations.columns


def test_invariant_to_row_order_and_other_entities(spark):
    rows = history(spark, "A", 5, future=[(500, 7, 0)]) + history(spark, "B", 3, future=[(300, 5.0, 0)])
    df = timeline(spark, [(*r[:3], float(r[3]), r[4]) for r in rows])
    once = co.future_outcome_cohort(df, SPEC).audit.orderBy("patient_id").collect()
    again = co.future_outcome_cohort(df.orderBy(F.rand(3)).repartition(5), SPEC).audit.orderBy("patient_id").collect()
    assert once == again
    alone = co.future_outcome_cohort(df.filter("patient_id = 'A'"), SPEC).audit.collect()
    assert alone == once[:1]
