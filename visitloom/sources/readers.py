"""Reading long CSV files and nested trajectories into typed visit tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import is_missing, missing_to_null, quoted, require_columns, try_date
from ..spec import DataError, LeakageError, VisitSpec

log = logging.getLogger(__name__)


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def coerce(df: DataFrame, spec: VisitSpec, *, integers: tuple[str, ...] = ("visit_number",),
           date_format: str | None = None) -> DataFrame:
    """Typed columns: trimmed text, numbers or NULL, a date."""
    new = {}
    kinds = dict(df.dtypes)
    whole = set(integers) | {spec.target, spec.flag}
    for c in df.columns:
        col = F.col(c)
        if c == spec.entity:
            new[c] = F.trim(col.cast("string"))
        elif c == spec.time:
            new[c] = try_date(col, date_format) if kinds[c] == "string" else col.cast("date")
        elif c in spec.categorical:
            new[c] = missing_to_null(col)
        elif c in whole:
            new[c] = col.try_cast("double").try_cast("int")
        elif c in spec.numeric:
            number = col.try_cast("double")
            new[c] = F.when(~F.isnan(number), number)
        elif c == spec.visit_id and kinds[c] == "string":
            new[c] = col.try_cast("long")
    return df.withColumns(new)


def check_rows(raw: DataFrame, spec: VisitSpec, where: str, date_format: str | None = None) -> None:
    """Raise for no rows, empty ids or dates that do not parse, from one pass."""
    text = F.col(spec.time).cast("string")
    rows = raw.select(F.col(spec.entity).alias("_e"), text.alias("_raw"), try_date(text, date_format).alias("_d"))
    bad = rows.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_missing(F.col("_e"))).alias("ids"),
        F.count_if(F.col("_d").isNull()).alias("dates")).first()
    if bad["rows"] == 0:
        raise DataError(f"no rows in {where}")
    if bad["ids"]:
        raise DataError(f"{bad['ids']} rows with an empty {spec.entity} in {where}")
    if bad["dates"]:
        sample = [r[0] for r in rows.filter(F.col("_d").isNull()).select("_raw").limit(5).collect()]
        raise DataError(f"{bad['dates']} rows with an unreadable {spec.time} in {where}, such as {sample}")


def read_visits_csv(spark: SparkSession, path: str, spec: VisitSpec = VisitSpec(), *,
                    expected: tuple[str, ...] = (), strict: bool = False,
                    date_format: str | None = None, check: bool = True) -> DataFrame:
    """A long CSV file or folder as a typed visit table.

    Absent required columns raise; absent expected ones are logged, or raise with
    ``strict``.  ``check`` reads the file once more to refuse empty ids and
    unreadable dates.
    """
    raw = normalize_names(spark.read.csv(path, header=True, inferSchema=False))
    require_columns(raw, [spec.entity, spec.time], f"read_visits_csv({path})")
    absent = [c for c in expected if c not in raw.columns]
    if absent:
        if strict:
            raise DataError(f"expected columns {absent} are not in {path}")
        log.warning("expected columns %s are not in %s", absent, path)
    typed = coerce(raw, spec, date_format=date_format)
    if check:
        check_rows(raw, spec, path, date_format)
    return typed


@dataclass
class Read:
    """Typed rows, and the records that were refused: the record's text and its reasons."""

    rows: DataFrame
    rejects: DataFrame


CORRUPT = "_corrupt_record"


def row_faults(columns: list[str], spec: VisitSpec, *, date_format: str | None = None,
               numbers: bool = False) -> Column:
    """Why a record of text columns is no visit, as an array: ``malformed``, ``empty_id``, ``unreadable_date``.

    With ``numbers`` also ``unreadable_number:<column>`` for text that is neither a number nor a missing value;
    without, such a cell becomes NULL.
    """
    day = try_date(F.col(spec.time).cast("string"), date_format)
    faults = [F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")),
              F.when(is_missing(F.col(spec.entity)), F.lit("empty_id")),
              F.when(day.isNull(), F.lit("unreadable_date"))]
    if numbers:
        faults += [F.when(~is_missing(F.col(c)) & F.col(c).try_cast("double").isNull(), F.lit(f"unreadable_number:{c}"))
                   for c in spec.numeric if c in columns]
    return F.array_compact(F.array(*faults))


def read_csv_with_rejects(spark: SparkSession, path: str, spec: VisitSpec = VisitSpec(), *,
                          date_format: str | None = None, numbers: bool = False) -> Read:
    """A long CSV file or folder: typed rows of the good records, and the others with their reasons.

    Lines with more or fewer fields than the header are ``malformed``.  Only absent required columns refuse the file.
    A record is judged on its own in the scan that reads it, so one bad line costs one line.
    """
    names = [c.strip().lower() for c in spark.read.csv(path, header=True, inferSchema=False).columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # every field of a line is looked at, even where a query wants few: a line is malformed for all or for none
    raw = spark.read.schema(schema).option("columnPruning", "false").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                                        enforceSchema=True)
    require_columns(raw, [spec.entity, spec.time], f"read_csv_with_rejects({path})")
    judged = raw.withColumn("_reasons", row_faults(names, spec, date_format=date_format, numbers=numbers))
    good = judged.filter(F.size("_reasons") == 0).select(*names)
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(c) for c in names])))
    refused = judged.filter(F.size("_reasons") > 0).select(
        F.input_file_name().alias("file"), record.alias("record"), F.col("_reasons").alias("reasons"))
    return Read(coerce(good, spec, date_format=date_format), refused)


def complete_layout(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Adds absent feature columns as NULL."""
    new = {c: F.lit(None).cast("double") for c in spec.numeric if c not in df.columns}
    new |= {c: F.lit(None).cast("string") for c in spec.categorical if c not in df.columns}
    return df.withColumns(new) if new else df


def trajectory_faults(spec: VisitSpec) -> dict[str, Column]:
    """Why a parsed document is refused, by name; see :func:`split_trajectories`."""
    named = [c.strip().lower() for c in spec.leakage]
    forbidden = F.exists("visits", lambda v: F.exists(F.map_keys(v), lambda k: F.lower(F.trim(k)).isin(*named)))
    undated = F.exists("visits", lambda v: v.isNull() | try_date(F.try_element_at(v, F.lit(spec.time))).isNull())
    return {"no_visits": F.coalesce(F.size("visits"), F.lit(0)) <= 0, "undated": undated, "forbidden": forbidden,
            "nobody": (F.size("visits") > 0) & F.col("owner").isNull()}


def parsed_documents(docs: DataFrame, column: str, spec: VisitSpec, entity_column: str | None = None,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """``document, owner, visits`` (maps of text), ``reasons`` and ``kept`` of every JSON document, parsed once."""
    text = F.regexp_replace(F.trim(F.col(column)), "^\\ufeff", "")
    as_object = F.when(text.startswith("["), F.concat(F.lit('{"visits":'), text, F.lit("}"))).otherwise(text)
    schema = T.StructType([T.StructField(spec.entity, T.StringType()),
                           T.StructField("visits", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    given = F.col(entity_column).cast("string") if entity_column else F.lit(None).cast("string")
    read = docs.select(F.col(column).alias("document"), F.from_json(as_object, schema).alias("d"), given.alias("_given"),
                       F.struct(F.lit(None).alias("_none"), *[quoted(c) for c in keep]).alias("kept"))
    owner = F.coalesce(missing_to_null(F.col(f"d.{spec.entity}")), missing_to_null(F.col("_given")))
    rows = read.select("document", owner.alias("owner"), F.col("d.visits").alias("visits"), "kept")
    return rows.withColumn("reasons", F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in trajectory_faults(spec).items()])))


def _visits_of(parsed: DataFrame, spec: VisitSpec) -> DataFrame:
    names = dict.fromkeys([*spec.order, "visit_number", *spec.numeric, *spec.categorical])
    visits = parsed.select(F.col("owner").alias(spec.entity), F.explode("visits").alias("v"))
    return complete_layout(coerce(visits.select(spec.entity, *[
        F.try_element_at("v", F.lit(c)).alias(c) for c in names if c != spec.entity]), spec), spec)


def split_trajectories(docs: DataFrame, column: str, spec: VisitSpec, *, entity_column: str | None = None,
                       keep: tuple[str, ...] = ()) -> Read:
    """Visits of the good JSON documents, one document per row, and the refused documents with their reasons.

    A document is an object with an id and ``visits``.  A bare list of visits, or an object without
    an id, belongs to the entity that the document column ``entity_column`` names.  Reasons: ``no_visits``
    (also text that is not JSON), ``undated`` (a visit lacks a readable date), ``forbidden`` (a visit has the key of
    a future column, whatever its value), ``nobody`` (no id anywhere).  A document is refused whole: a
    trajectory with a hole is no trajectory.  Refused documents keep the columns ``keep`` of ``docs``.
    """
    parsed = parsed_documents(docs, column, spec, entity_column, keep)
    return Read(_visits_of(parsed.filter(F.size("reasons") == 0), spec),
                parsed.filter(F.size("reasons") > 0).select(
                    *[F.col("kept")[c].alias(c) for c in keep], F.col("document").alias("record"), "reasons"))


def parse_trajectories(docs: DataFrame, column: str, spec: VisitSpec, *, check: bool = True,
                       entity_column: str | None = None) -> DataFrame:
    """Visits of JSON documents; with ``check`` any document that :func:`split_trajectories` would refuse raises."""
    parsed = parsed_documents(docs, column, spec, entity_column)
    if check:
        r = parsed.groupBy().agg(*[F.count_if(F.array_contains("reasons", name)).alias(name)
                                   for name in trajectory_faults(spec)]).first()
        if r["no_visits"]:
            raise DataError(f"{r['no_visits']} documents are not JSON or have no visits")
        if r["undated"]:
            raise DataError(f"{r['undated']} documents have a visit without a readable {spec.time}")
        if r["forbidden"]:
            raise LeakageError(f"{r['forbidden']} documents name a future column")
        if r["nobody"]:
            raise DataError(f"{r['nobody']} documents have no {spec.entity}")
    return _visits_of(parsed, spec)


def read_trajectories(spark: SparkSession, path: str, spec: VisitSpec = VisitSpec(), *,
                      lines: bool = False, check: bool = True) -> DataFrame:
    """Trajectory files as visits: a document per file, or with ``lines`` a document per line.

    A file's document without an id is of the entity that the file is named after.
    """
    docs = spark.read.text(path, wholetext=not lines)
    if lines:
        return parse_trajectories(docs, "value", spec, check=check)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return parse_trajectories(docs.select("value", stem.alias("_stem")), "value", spec, check=check,
                              entity_column="_stem")
