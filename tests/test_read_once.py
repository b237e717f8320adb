"""Queries that read their input several times derive it once."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import queries, tables
from visitloom.plans import explain as ex, search as sr, selection as se, training as tr

SF = "/root/testdata/sf0.001"
N = tables.NARROW
TRIAL = sr.Trial(0, "logistic_regression", (("max_iter", 3),))


def counted(df):
    """The same rows, and a counter of the rows made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_training_derives_its_visits_once(spark):
    visits, made = counted(tables.visits(spark, SF))
    assert tr.train(spark, visits, N, [TRIAL]).test_metrics.first().test_n_samples > 0
    assert made.value == tables.table(spark, SF, "orders").count()


def test_permutation_derives_its_rows_once(spark):
    rows, made = counted(spark.range(60).select(F.col("id").alias("entity_id"), F.col("id").cast("double").alias("x"),
                                                (F.col("id") % 3 == 0).cast("int").alias("label")))
    data = rows.select("entity_id", array_to_vector(F.array(F.col("x"), -F.col("x"))).alias("features"), "label")
    scorer = queries.FixedScorer(0.0, [0.1, -0.1])
    assert ex.permutation_importance(scorer, data, "entity_id", ["a", "b"], repeats=2).count() == 2
    assert made.value == 60


def test_requests_and_patients_of_a_selection_are_derived_once(spark):
    visits = tables.visits(spark, SF).persist()
    requests, made = counted(queries.score_requests(spark, SF))
    patients, read = counted(tables.table(spark, SF, "customer").select(F.col("c_custkey").alias("entity_id")))
    out = se.score_selection(queries.fixed_artifact(visits), requests, patients, visits)
    assert out.filter("p IS NOT NULL").count() == out.filter("status = 'ok'").count() > 0
    assert made.value == queries.score_requests(spark, SF).count()
    assert read.value == tables.table(spark, SF, "customer").count()
    visits.unpersist()


@pytest.mark.parametrize("name", ["permutation_fixed", "score_selection_fixed", "transform_wide_full", "score_batch",
                                  "temporal_occlusion"])
def test_a_query_derives_the_visits_once(spark, monkeypatch, name):
    visits, made = counted(tables.visits(spark, SF))
    monkeypatch.setattr(tables, "visits", lambda *_, **__: visits)
    assert queries.QUERIES[name](spark, SF).count() > 0
    assert made.value == tables.table(spark, SF, "orders").count()
