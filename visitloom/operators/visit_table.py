"""Keeping a table of patients and visits, in batches.

``patients``: ``id, <entity>``; ``visits``: visit id, entity and the columns of
the spec.  Changes come as a log; the newest change of every field wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import sort_cuts
from ..spec import VisitSpec
from .ordered import positions


def normalized_ids(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Trimmed ids, case kept; rows with an empty id are left out (see :func:`rejected_ids`)."""
    e = F.trim(F.col(spec.entity).cast("string"))
    return df.withColumn(spec.entity, e).filter(F.col(spec.entity).isNotNull() & (F.col(spec.entity) != ""))


def rejected_ids(df: DataFrame, spec: VisitSpec) -> DataFrame:
    e = F.trim(F.col(spec.entity).cast("string"))
    return df.filter(e.isNull() | (e == ""))


def clean_clinical(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Entity, order and clinical columns only; empty text becomes NULL."""
    used = [c for c in (*spec.numeric, *spec.categorical) if c in df.columns]
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    head = [spec.entity, *[c for c in spec.order if c not in used]]
    return df.select(*head, *[F.nullif(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in used])


def register_patients(patients: DataFrame, incoming: DataFrame, spec: VisitSpec, **kw) -> DataFrame:
    """Patients with the new ids added; known ids keep their row, ids go on from the highest."""
    e = spec.entity
    fresh = normalized_ids(incoming.select(e), spec).distinct().join(patients.select(e), e, "left_anti")
    placed = positions(fresh, [], [F.col(e)], sort_cuts(fresh, [e]), "_i", **kw)
    top = patients.groupBy().agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_top"))
    new = placed.withColumn("_k", F.lit(1)).join(F.broadcast(top.withColumn("_k", F.lit(1))), "_k")   # one row
    return patients.select("id", e).unionByName(new.select((F.col("_top") + F.col("_i") + 1).alias("id"), e))


def visit_history(visits: DataFrame, patients: DataFrame, spec: VisitSpec, **kw) -> DataFrame:
    """Visits of known patients with their 1-based number in (date, visit id) order."""
    known = visits.join(patients.select(spec.entity), spec.entity, "left_semi")
    numbered = positions(known, [spec.entity], [F.col(c) for c in spec.order],
                         sort_cuts(known, spec.order), "_i", **kw)
    return numbered.withColumn("visit_number", (F.col("_i") + 1).cast("int")).drop("_i")


@dataclass
class Changes:
    visits: DataFrame
    rejected: DataFrame     # log rows and the reason


def apply_changes(visits: DataFrame, log: DataFrame, spec: VisitSpec) -> Changes:
    """Add, update and delete visits from ``seq, op, entity, visit_id, fields``.

    ``fields`` is a ``map<string,string>``: a key that is present is a supplied
    value, NULL or ``""`` clears it, and an absent key leaves the field alone.
    Only the owner of a visit may change it; an update or delete needs an earlier
    add and no earlier delete.  Stored visits that the log does not name pass
    through as they are; the others are aggregated per visit.
    """
    stored = visits
    named = log.select(spec.visit_id).distinct()
    visits = stored.join(named, spec.visit_id, "left_semi")
    e, v = spec.entity, spec.visit_id
    columns = [c for c in visits.columns if c not in (e, v)]
    types = dict(visits.dtypes)
    entries = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    base = visits.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), e, v,
                         F.create_map(*entries).alias("fields"))
    events = base.unionByName(log.select(F.col("seq").cast("long").alias("seq"), "op", e, v, "fields"))
    adds = events.filter("op = 'add'").groupBy(v).agg(
        F.min("seq").alias("_added"), F.min_by(e, "seq").alias("_owner"))
    known = events.join(adds, v, "left")
    gone = (known.filter((F.col("op") == "delete") & (F.col(e) == F.col("_owner"))
                         & (F.col("seq") > F.col("_added")))
            .groupBy(v).agg(F.min("seq").alias("_deleted")))
    known = known.join(gone, v, "left")
    seq = F.col("seq")
    reason = (F.when((F.col("op") == "add") & (seq > F.col("_added")), "duplicate_visit")
              .when(F.col("op") == "add", None)
              .when(F.col("_added").isNull() | (seq < F.col("_added")), "unknown_visit")
              .when(F.col(e) != F.col("_owner"), "not_owner")
              .when(seq > F.col("_deleted"), "unknown_visit"))
    known = known.withColumn("reason", reason)
    good = known.filter(F.col("reason").isNull() & F.col("_deleted").isNull())

    def newest(c):
        given = F.map_contains_key("fields", F.lit(c))
        if c == spec.time:   # a date cannot be cleared
            given = given & (F.coalesce(F.trim(F.try_element_at("fields", F.lit(c))), F.lit("")) != "")
        value = F.nullif(F.try_element_at("fields", F.lit(c)), F.lit(""))
        return F.max_by(value, F.when(given, seq)).try_cast(types[c]).alias(c)

    merged = good.groupBy(v).agg(F.max("_owner").alias(e), *[newest(c) for c in columns])
    rejected = known.filter(F.col("reason").isNotNull()).select("seq", "op", e, v, "reason")
    untouched = stored.join(named, v, "left_anti").select(*stored.columns)
    return Changes(untouched.unionByName(merged.select(*stored.columns)), rejected)


def select_visits(selection: DataFrame, visits: DataFrame, spec: VisitSpec, window: int,
                  patients: DataFrame | None = None) -> DataFrame:
    """Requested ``entity, visit_id`` pairs with a status per entity.

    ``unknown_patient`` where ``patients`` are given and lack the entity, ``unknown_visit``, then ``not_owner``, then ``too_many`` when more than
    ``window`` visits are asked for; a request is refused whole, never cut.
    """
    e, v = spec.entity, spec.visit_id
    owners = visits.select(v, F.col(e).alias("_owner"), *[F.col(c) for c in spec.order if c != v])
    found = selection.select(e, v).join(owners, v, "left")
    per = found.groupBy(e).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_owner").isNull()).alias("_unknown"),
        F.count_if(F.col("_owner") != F.col(e)).alias("_foreign"))
    known = F.lit(True)
    if patients is not None:
        per = per.join(patients.select(F.col(e), F.lit(True).alias("_known")).distinct(), e, "left")
        known = F.col("_known").isNotNull()
    status = (F.when(~known, "unknown_patient").when(F.col("_unknown") > 0, "unknown_visit").when(F.col("_foreign") > 0, "not_owner")
              .when(F.col("_n") > window, "too_many").otherwise("ok"))
    return found.join(per.select(e, status.alias("status")), e).select(e, v, *[
        c for c in spec.order if c != v], "status")
