"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..spec import DataError


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: adaptive plans, and skewed joins split even if that costs a shuffle.

    An entity with a third of all rows makes one join partition large; without the
    force setting Spark leaves it whole when an aggregation on the same key follows.
    Wide tables have more columns than whole-stage code generation takes by default.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.codegen.maxFields": "1000",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a machine-local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise DataError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The same rows as a table in the shared folder: computed once, lineage cut, executors may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
