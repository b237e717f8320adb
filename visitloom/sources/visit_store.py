"""A stored visit table, bucketed by visit id, that changes by whole buckets and never half.

``data/gen=G/bucket=B`` holds a bucket as generation G (version and a random name) wrote it, ``versions/N`` the list of buckets with the generation
that is current and its rows.  A change reads the buckets that its log names, writes them as a new generation
and then the new list; the list is visible once Spark has marked it complete, so readers see the version before or
the one after.  Other buckets are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.visit_table import Changes, apply_changes
from ..spec import DataError, VisitSpec

BUCKET, GENERATION = "bucket", "gen"


@dataclass
class VisitStore:
    """One version of a store.  The buckets are few (a parameter): their list may reach the driver."""

    spark: SparkSession
    root: str
    spec: VisitSpec
    version: int
    buckets: int
    schema: T.StructType
    current: dict[int, tuple[str, int]]      # bucket: generation, rows

    # --- opening -----------------------------------------------------------------

    @classmethod
    def create(cls, root: str, visits: DataFrame, spec: VisitSpec, buckets: int = 64) -> "VisitStore":
        """Version 1 of a new store; visit ids have to be unique and not NULL."""
        spark = visits.sparkSession
        if versions(spark, root):
            raise DataError(f"{root} holds a store already")
        bad = visits.groupBy(spec.visit_id).agg(F.count(F.lit(1)).alias("n")).filter(
            (F.col("n") > 1) | F.col(spec.visit_id).isNull())
        if not bad.isEmpty():
            raise DataError(f"{spec.visit_id} is not unique, or missing")
        store = cls(spark, root.rstrip("/"), spec, 0, buckets, visits.schema, {})
        return store._publish(visits, range(buckets), 1)

    @classmethod
    def open(cls, spark: SparkSession, root: str, spec: VisitSpec, version: int | None = None) -> "VisitStore":
        """The newest complete version, or the given one."""
        root, known = root.rstrip("/"), versions(spark, root)
        version = version if version is not None else max(known, default=None)
        if version not in known:
            raise DataError(f"no complete version {version if version is not None else ''} of a store in {root}")
        rows = spark.read.parquet(f"{root}/versions/{version}").collect()       # a row per bucket
        return cls(spark, root, spec, version, len(rows), T.StructType.fromJson(json.loads(rows[0]["schema"])),
                   {r[BUCKET]: (r[GENERATION], r["n_rows"]) for r in rows})

    # --- reading -----------------------------------------------------------------

    def bucket_of(self, visit_id: Column) -> Column:
        return F.pmod(F.xxhash64(visit_id.cast(self.schema[self.spec.visit_id].dataType)), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The visits of the given buckets, or all; other files are not listed."""
        wanted = self.current if buckets is None else buckets
        paths = [f"{self.root}/data/{GENERATION}={self.current[b][0]}/{BUCKET}={b}" for b in wanted if self.current[b][1]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, ids: DataFrame) -> list[int]:
        """Buckets of the visit ids, at most all of them."""
        own = ids.select(self.bucket_of(F.col(self.spec.visit_id)).alias(BUCKET)).distinct()
        return sorted(r[BUCKET] for r in own.collect())

    # --- changing ----------------------------------------------------------------

    def apply(self, log: DataFrame) -> tuple["VisitStore", DataFrame]:
        """(the next version, rejected log rows); see :func:`apply_changes` for the log.

        Two writers of one version cannot both publish: the second fails, and tries again on the new version.
        """
        buckets = self.touched(log)
        if not buckets:
            return self, self.spark.createDataFrame([], apply_changes(self.read([]), log, self.spec).rejected.schema)
        done: Changes = apply_changes(self.read(buckets), log, self.spec)
        after = self._publish(done.visits.select(*self.schema.names), buckets, self.version + 1)
        return after, done.rejected

    def _publish(self, visits: DataFrame, buckets, version: int) -> "VisitStore":
        data, gen = f"{self.root}/data", f"{version}-{uuid.uuid4().hex[:12]}"       # no writer meets another's files
        (visits.withColumn(GENERATION, F.lit(gen)).withColumn(BUCKET, self.bucket_of(F.col(self.spec.visit_id)))
         .repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(GENERATION, BUCKET).parquet(data))
        fs, path = _files(self.spark, self.root)
        counts = {}
        if fs.exists(path(f"{data}/{GENERATION}={gen}")):       # absent when no visit is left
            written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
            counts = {r[BUCKET]: r["n"] for r in written.parquet(f"{data}/{GENERATION}={gen}").groupBy(BUCKET).agg(
                F.count(F.lit(1)).alias("n")).collect()}
        current = self.current | {b: (gen, counts.get(b, 0)) for b in buckets}
        rows = [(b, g, n, self.schema.json()) for b, (g, n) in sorted(current.items())]
        self.spark.createDataFrame(rows, f"{BUCKET} int, {GENERATION} string, n_rows long, schema string").coalesce(
            1).write.mode("errorifexists").parquet(f"{self.root}/versions/{version}")
        return VisitStore(self.spark, self.root, self.spec, version, self.buckets, self.schema, current)

    def forget_before(self, version: int) -> int:
        """Remove older versions, and generations that none of the others has; returns how many folders went."""
        fs, path = _files(self.spark, self.root)
        stay = {(g, b) for v in versions(self.spark, self.root) if v >= version
                for b, (g, n) in VisitStore.open(self.spark, self.root, self.spec, v).current.items() if n}
        gone = 0
        for v in versions(self.spark, self.root):
            if v < version:
                gone += fs.delete(path(f"{self.root}/versions/{v}"), True)
        for gen in fs.listStatus(path(f"{self.root}/data")):
            for bucket in fs.listStatus(gen.getPath()) if gen.isDirectory() else []:
                name = (gen.getPath().getName().split("=")[1], int(bucket.getPath().getName().split("=")[1]))
                if int(name[0].split("-")[0]) < version and name not in stay:
                    gone += fs.delete(bucket.getPath(), True)
        return gone


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of a store that were written completely."""
    fs, path = _files(spark, root)
    top = path(f"{root.rstrip('/')}/versions")
    if not fs.exists(top):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(top)
                  if fs.exists(path(s.getPath(), "_SUCCESS")))
