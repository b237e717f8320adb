"""Writing timelines, leaderboards, metrics and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import as_flag
from ..operators.guards import strip_leakage
from ..operators.profile import dataset_metadata
from ..spec import DataError, VisitSpec

RUN_SCHEMA_VERSION = "1.0"
RUN_SCHEMA = (
    "schema_version string, run_id string, config_hash string, seeds map<string,long>, dataset_id string, "
    "split_id string, condition struct<kind:string,strength:double,params:map<string,string>>, "
    "metrics map<string,double>, metadata map<string,string>, created_utc string")


def observation_rows(timeline: DataFrame, spec: VisitSpec) -> DataFrame:
    """Rows that are not future visits, without future columns."""
    rows = timeline.filter(~as_flag(timeline, spec.future)) if spec.future in timeline.columns else timeline
    return strip_leakage(rows, spec)


def write_timeline(timeline: DataFrame, spec: VisitSpec, folder: str, fmt: str = "parquet") -> None:
    """Full timeline, observation-only table and metadata below ``folder``."""
    options = {"header": True} if fmt == "csv" else {}
    timeline.write.mode("overwrite").format(fmt).options(**options).save(f"{folder}/full_timeline")
    (observation_rows(timeline, spec).write.mode("overwrite").format(fmt).options(**options)
     .save(f"{folder}/observations"))
    dataset_metadata(timeline, spec).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def write_leaderboard(board: DataFrame, path: str) -> None:
    """One CSV row per trial, best first."""
    (board.orderBy(F.col("validation_auroc").desc(), "trial").coalesce(1)
     .write.mode("overwrite").csv(path, header=True))


def write_best_config(board: DataFrame, path: str) -> None:
    """The best trial as one JSON record."""
    best = board.orderBy(F.col("validation_auroc").desc(), "trial").limit(1)
    if best.isEmpty():
        raise DataError("no completed trial to choose from")
    best.withColumn("selection_criterion", F.lit("validation_auroc")).coalesce(1).write.mode(
        "overwrite").json(path)


def write_record(record: DataFrame, path: str) -> None:
    """Small tables as JSON: metrics, summaries, explanations."""
    record.coalesce(1).write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A table written by :func:`write_record`, with the types of ``like`` when given."""
    reader = spark.read.schema(like.schema) if like is not None else spark.read
    return reader.json(path)


def invalid_runs(runs: DataFrame) -> DataFrame:
    """Run records that break a rule: empty id, another version, unnamed or non-finite metric."""
    names = F.map_keys("metrics")
    values = F.map_values("metrics")
    bad = (F.col("run_id").isNull() | (F.trim("run_id") == "")
           | ~F.col("schema_version").eqNullSafe(F.lit(RUN_SCHEMA_VERSION))
           | F.col("condition.kind").isNull()
           | F.coalesce(F.exists(names, lambda k: F.trim(k) == ""), F.lit(False))
           | F.coalesce(F.exists(values, lambda x: F.isnan(x)), F.lit(False)))
    return runs.filter(bad)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append valid run records to a table."""
    bad = [r[0] for r in invalid_runs(runs).select("run_id").limit(5).collect()]
    if bad:
        raise DataError(f"invalid run records: {bad}")
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def metrics_map(row: DataFrame, keys: list[str]) -> DataFrame:
    """A metric row with its metric columns folded into one ``map<string,double>``."""
    names = [c for c in row.columns if c not in keys]
    entries = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return row.select(*keys, F.create_map(*entries).alias("metrics"))
