"""Registered queries against their SQL at the smallest scale; results that must not depend on skew."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import tables
from checks.compare import TABLES, canonical
from visitloom.operators import cohort as co, metrics as me, perturb as pe, splits as sp, wide as wi

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 95


@pytest.mark.parametrize("name", [
    "cohort_outcome", "cohort_flagged_observation", "cohort_prelabeled_audit", "wide_slope", "seq_long",
    "split_stratified", "transform_wide", "auroc_by_source", "calibration_report", "spearman", "findings",
    "profile_numeric", "jitter_timing", "apply_visit_changes", "trajectories_json"])
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rel = db.execute(entry.oracle_sql()[name])
    want = canonical([d[0] for d in rel.description], rel.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_id", "status", "target"] and df.count() == 150


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all visits belong to entity 0."""
    v = tables.visits(spark, SF)
    return v.withColumn("entity_id", F.when(F.col("visit_id") % 3 == 0, 0).otherwise(F.col("entity_id"))).cache()


@pytest.mark.parametrize("run", [
    lambda d, **k: wi.wide_features(d, tables.NARROW, **k),
    lambda d, **k: pe.remove_visits(d, tables.NARROW, 0.4, **k),
    lambda d, **k: pe.jitter_visit_timing(d, tables.NARROW, 20, **k),
    lambda d, **k: sp.stratified_split(d.select("entity_id", F.lit(1).alias("target")).distinct(), tables.NARROW, **k),
    lambda d, **k: me.metric_row(d.select(F.col("event_flag").alias("y"), (F.col("amount") / 600000).alias("p")), **k)])
def test_hot_entity_is_cut_but_the_answer_stays(hot, run):
    def shape(df):
        return canonical(df.columns, [tuple(r) for r in df.collect()])

    assert shape(run(hot, rows_per_task=60)) == shape(run(hot, bounded=True))


def test_hot_entity_plan_has_no_whole_group_window(hot):
    out = co.future_outcome_cohort(hot, tables.NARROW)
    plan = out.observations._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("Window [")
    assert windows and plan.count("WindowGroupLimit") == 2 * windows   # before and after the shuffle
