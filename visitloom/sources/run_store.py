"""Runs of several tables that readers see whole or not at all.

The tables of a run are written first, each attempt into a folder of its own. The manifest, one small file that
names every table with its rows and its schema, is written last: a run without it is not there, whatever lies in
its folder, and a later attempt at the same run starts afresh beside the leftovers. This takes a file system
that renames a folder in one step, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..spec import DataError

MANIFEST = "run_id string, part string, path string, n_rows long, n_parts int, schema string"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def publish_run(parts: dict[str, DataFrame], folder: str, run_id: str) -> DataFrame:
    """Write ``parts`` as the run ``run_id`` below ``folder`` and return its manifest.

    Rows are counted in the written files (their footers), not in the plan, so a part is computed once and the
    number is what a reader will find. A run that is published already is refused and stays as it is.
    """
    if not parts:
        raise DataError("a run needs at least one part")
    for name in (run_id, *parts):
        if not name or not all(c.isalnum() or c in "_-" for c in name):
            raise DataError(f"not a name for a folder: {name!r}")
    spark = next(iter(parts.values())).sparkSession
    manifest = f"{folder}/{run_id}/manifest"
    if _exists(spark, manifest):
        raise DataError(f"run {run_id} is published already")
    attempt, rows = uuid.uuid4().hex[:12], []
    for name, df in parts.items():
        path = f"{attempt}/{name}"
        df.write.parquet(f"{folder}/{run_id}/{path}")
        found = spark.read.schema(df.schema).parquet(f"{folder}/{run_id}/{path}").count()
        rows.append((run_id, name, path, found, len(parts), df.schema.json()))
    # written beside its place and renamed: the rename is what publishes; where two attempts meet, the first one has it
    staged = f"{folder}/{run_id}/{attempt}/manifest"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(staged)
    source, files = _path(spark, staged)
    target, _ = _path(spark, manifest)
    if files.exists(target) or not files.rename(source, target):
        raise DataError(f"run {run_id} is published already")
    listed = manifest_of(spark, folder, run_id)
    if not listed.filter(~F.startswith("path", F.lit(f"{attempt}/"))).isEmpty():
        raise DataError(f"run {run_id} was published by another attempt")
    return listed


def manifest_of(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The manifest of a published run; DataError if there is none or it is not whole."""
    path = f"{folder}/{run_id}/manifest"
    if not _exists(spark, f"{path}/_SUCCESS"):
        raise DataError(f"run {run_id} is not published")
    rows = spark.read.schema(MANIFEST).json(path)
    have = rows.agg(F.count(F.lit(1)).alias("n"), F.max("n_parts").alias("of")).first()
    if have["n"] == 0 or have["n"] != have["of"]:
        raise DataError(f"the manifest of run {run_id} is not whole")
    return rows


def read_run(spark: SparkSession, folder: str, run_id: str) -> dict[str, DataFrame]:
    """The parts of a published run, with the types they were written with.

    DataError if the run is not published, or if a part has not the rows its manifest names (lost or added files).
    """
    parts = {}
    for r in manifest_of(spark, folder, run_id).collect():     # one row per part
        path = f"{folder}/{run_id}/{r['path']}"
        if not _exists(spark, path):
            raise DataError(f"part {r['part']} of run {run_id} is missing")
        df = spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(path)
        found = df.count()
        if found != r["n_rows"]:
            raise DataError(f"part {r['part']} of run {run_id} has {found} rows, not {r['n_rows']}")
        parts[r["part"]] = df
    return parts
