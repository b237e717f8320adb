"""Above the group limit of Spark, first and last rows of a hot entity are found over ranges."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import tables
from checks.compare import canonical
from visitloom.operators import cohort as co, ordered, perturb as pe, sequence as se
from visitloom.spec import CohortRules

SF = "/root/testdata/sf0.001"
RULES = replace(CohortRules(), max_visits=40)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all visits belong to entity 0, and a third of those have no date."""
    v = tables.timeline(spark, SF).withColumn("target", F.lit(1))
    v = v.withColumn("entity_id", F.when(F.col("visit_id") % 3 == 0, 0).otherwise(F.col("entity_id")))
    return v.withColumn("visit_date", F.when((F.col("entity_id") != 0) | (F.col("visit_id") % 9 != 0),
                                             F.col("visit_date"))).cache()


@pytest.mark.parametrize("run", [
    lambda d, n, **k: pe.truncate_to_recent_visits(d, n, 40, **k),
    lambda d, n, **k: se.recent_steps(d, n, 40, **k),
    lambda d, n, **k: co.future_outcome_cohort(d, n, RULES, **k).observed,
    lambda d, n, **k: co.future_outcome_cohort(d.drop("is_future_visit"), n, RULES, **k).observed,
    lambda d, n, **k: co.prelabeled_cohort(d, n, RULES, **k).observed])
def test_rows_beyond_the_group_limit(hot, monkeypatch, run):
    def shape(df):
        return canonical(df.columns, [tuple(map(str, r)) for r in df.collect()])

    want = shape(run(hot, tables.NARROW))
    monkeypatch.setattr(ordered, "GROUP_LIMIT", 5)
    cut = run(hot, tables.NARROW, rows_per_task=60)
    assert shape(cut) == want and len(want[1]) > 500
    assert "_range0" in cut._jdf.queryExecution().optimizedPlan().toString()
