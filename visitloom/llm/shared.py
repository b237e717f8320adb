"""Intermediate tables in the shared folder, and connected components as joins over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a machine-local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and written to the shared folder; a lost executor loses none."""
    path = folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def tidy(spark: SparkSession) -> SparkSession:
    """Spark removes the shuffle files of every query that has ended, so only those of the running one take disk."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


class Scratch:
    """Intermediate tables of one job; each can be removed as soon as the tables made from it are written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.tables = spark, folder(spark, name), 0

    def kept(self, df: DataFrame) -> DataFrame:
        path, schema = f"{self.root}/{self.tables}", df.schema
        self.tables += 1
        df.write.parquet(path)
        again = self.spark.read.schema(schema).parquet(path)
        again._kept_in = path
        return again

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._kept_in)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame, rounds: int = 60, partly: bool = False) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node it reaches.

    Alternates large-star and small-star steps until every component is a star. Each step is a shuffle by
    node with partial minimums; neighbours are joined, never gathered into one row. Nothing reaches the
    driver but one flag per step. ``partly`` takes one step only: equal roots are then still connected, but
    not all connected nodes have equal roots.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .distinct(), "edges")
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["n"]).select(
            F.explode(F.array("a", "n")).alias("b"), F.col("m").alias("a")).filter("a <> b")
        edges = kept(small.select("a", "b").distinct(), "edges")
        if partly:
            break
        ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("leaf")).union(
            edges.select(F.col("b").alias("n"), F.lit(1).alias("leaf")))
        if ends.groupBy("n").agg(F.sum("leaf").alias("s"), F.min("leaf").alias("lo")).filter(
                "s > 1 or (s = 1 and lo = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return both.groupBy("node").agg(F.min("root").alias("root"))
