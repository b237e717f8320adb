"""The given tables seen as visits, predictions, score tables and change logs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitloom.spec import VisitSpec

SPEC = VisitSpec(
    entity="entity_id", time="visit_date", visit_id="visit_id",
    numeric=("amount", "quantity", "n_lines", "discount"), categorical=("status", "priority", "segment"),
    yes_no=("bulk",), flag="event_flag", measure="amount", threshold=450000.0)
NARROW = replace(SPEC, categorical=("status", "priority"))
FUTURE_FROM = "1998-07-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def visits(spark: SparkSession, sf: str, *, segment: bool = False) -> DataFrame:
    """Orders as visits of customers; measurements from lineitem, NULL for orders without lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_discount").alias("discount"))
    orders = table(spark, sf, "orders")
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    columns = [
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("visit_id"),
        F.col("o_orderdate").cast("date").alias("visit_date"), F.col("o_totalprice").alias("amount"),
        "quantity", "n_lines", "discount",
        F.coalesce((F.col("n_lines") >= 10).cast("int"), F.lit(0)).alias("event_flag"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")]
    if segment:
        customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
        rows = rows.join(customer, rows["o_custkey"] == customer["c_custkey"], "left")
        columns.append(F.col("c_mktsegment").alias("segment"))
    return rows.select(*columns)


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Visits with a textual future flag."""
    late = F.col("visit_date") >= F.lit(FUTURE_FROM).cast("date")
    return visits(spark, sf).withColumn("is_future_visit", F.when(late, "True").otherwise("False"))


def labelled_visits(spark: SparkSession, sf: str, *, consistent: bool = True) -> DataFrame:
    """Visits with a target: by customer balance, or by order status, which changes within entities."""
    rows = visits(spark, sf)
    if not consistent:
        return rows.withColumn("target", (F.col("status") == "F").cast("int"))
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return rows.join(customer, "entity_id", "left")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Document quality labels with a score made from the document length."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("y"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0))).alias("p"))


def part_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two signed scores per part, over partly different parts."""
    lines = table(spark, sf, "lineitem")
    a = lines.filter("l_returnflag <> 'A'").groupBy(F.col("l_partkey").alias("key")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")))
        .alias("score"))
    b = lines.filter("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("key")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")))
        .alias("score"))
    return a, b


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log over orders: every visit is updated, some by a stranger, some deleted, some unknown."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("seq"), "o_totalprice")
    v = F.col("visit_id")
    owner = F.when(v % 13 == 0, F.col("entity_id") + 1).otherwise(F.col("entity_id"))
    update = o.select((F.col("seq") * 10).alias("seq"), F.lit("update").alias("op"), owner.alias("entity_id"),
                      "visit_id", F.when(v % 2 == 0, F.create_map(
                          F.lit("amount"), (F.col("o_totalprice") + 1000).cast("string"),
                          F.lit("priority"), F.lit("")))
                      .otherwise(F.create_map(F.lit("status"), F.lit("X"))).alias("fields"))
    empty = F.create_map().cast("map<string,string>")
    delete = o.filter(v % 11 == 0).select(
        (F.col("seq") * 10 + 1).alias("seq"), F.lit("delete").alias("op"), "entity_id", "visit_id",
        empty.alias("fields"))
    stray = o.filter(v % 17 == 0).select(
        (F.col("seq") * 10 + 2).alias("seq"), F.lit("update").alias("op"), "entity_id",
        (-v).alias("visit_id"), F.create_map(F.lit("status"), F.lit("Y")).alias("fields"))
    fresh = o.filter(v % 19 == 0).select(
        (F.col("seq") * 10 + 3).alias("seq"), F.lit("add").alias("op"), "entity_id",
        (v + 1_000_000_000).alias("visit_id"),
        F.create_map(F.lit("visit_date"), F.lit("2002-01-01"), F.lit("status"), F.lit("N")).alias("fields"))
    return update.unionByName(delete).unionByName(stray).unionByName(fresh)
