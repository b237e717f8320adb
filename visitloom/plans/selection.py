"""Scores for chosen visits of stored patients: every request gets a status, accepted ones a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.visit_table import normalized_ids
from ..sources.session import written
from ..spec import VisitSpec
from .training import Artifact


def judge_requests(requests: DataFrame, patients: DataFrame, visits: DataFrame, spec: VisitSpec,
                   window: int) -> tuple[DataFrame, DataFrame]:
    """(verdicts, chosen): a row per request with its status, and the visits of the accepted ones.

    ``requests`` has ``request, <entity>, visit_ids`` (an array), a row per request.  The first that holds of:
    ``empty_selection`` (no ids, or NULL), ``unknown_patient`` (also an empty id), ``unknown_visit``, ``not_owner``,
    ``too_many`` (more than ``window``; never cut), else ``ok``.  An id asked for twice counts twice.  ``chosen`` has
    ``request`` and the columns of ``visits``.  Requests, their visits and the verdicts are stored, for each is read
    several times: by the verdicts, the lists and the scores.
    """
    e, v = spec.entity, spec.visit_id
    given = written(requests.select("request", F.trim(F.col(e).cast("string")).alias("_who"),
                                    F.coalesce(F.size("visit_ids"), F.lit(0)).alias("n_visits"), "visit_ids"), "requests")
    known = normalized_ids(patients.select(e), spec).select(F.col(e).alias("_who"), F.lit(True).alias("_known")).distinct()
    asked = given.select("request", "_who", F.explode("visit_ids").alias(v))
    found = written(asked.join(visits.withColumn("_owner", F.trim(F.col(e).cast("string"))), v, "left"), "chosen-visits")
    owner = F.col("_owner")
    per = found.groupBy("request").agg(F.count_if(owner.isNull()).alias("_unknown"),
                                       F.count_if(owner != F.col("_who")).alias("_foreign"))
    status = (F.when(F.col("n_visits") < 1, "empty_selection").when(F.col("_known").isNull(), "unknown_patient")
              .when(F.col("_unknown") > 0, "unknown_visit").when(F.coalesce(F.col("_foreign"), F.lit(1)) > 0, "not_owner")
              .when(F.col("n_visits") > window, "too_many").otherwise("ok"))
    verdicts = written(given.join(known, "_who", "left").join(per, "request", "left").select(
        "request", F.col("_who").alias(e), F.greatest("n_visits", F.lit(0)).alias("n_visits"), status.alias("status")), "verdicts")
    ok = verdicts.filter("status = 'ok'").select("request")
    return verdicts, found.join(ok, "request", "left_semi").select("request", *visits.columns)


def score_selection(artifact: Artifact, requests: DataFrame, patients: DataFrame, visits: DataFrame) -> DataFrame:
    """``request, <entity>, n_visits, status, visit_ids, dates, p, prediction``, one row per request.

    Accepted selections are scored in one plan, each as an entity of its own; their visits are listed in time order.
    The lists are NULL, and so is the score, for a request that is refused.
    """
    spec = artifact.spec
    e, v = spec.entity, spec.visit_id
    verdicts, chosen = judge_requests(requests, patients, visits, spec, artifact.window)
    rows = chosen.drop(e).withColumnRenamed("request", e)      # an entity per request: one patient may ask twice
    scored = artifact.score(rows, bounded=True).select(F.col(e).alias("request"), "p", "prediction")
    keys = [c for c in spec.order if c != v]
    listed = chosen.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(*keys, v))).alias("_v")).select(
        "request", F.col(f"_v.{v}").alias("visit_ids"), F.col(f"_v.{spec.time}").alias("dates"))   # at most a window
    return verdicts.join(listed, "request", "left").join(scored, "request", "left").select(
        "request", e, "n_visits", "status", "visit_ids", "dates", "p", "prediction")
