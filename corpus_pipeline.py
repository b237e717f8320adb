"""From raw documents to packed training sequences, one operator a stage; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitloom.llm.blob_ledger import redact, scan_history
from visitloom.llm.common import WORD, prepare, table
from visitloom.llm.conflict_packing import PackRules, pack_texts
from visitloom.llm.prefix_groups import jaccard_join
from visitloom.llm.run_index import remove_repeats
from visitloom.llm.shared import kept
from visitloom.llm.target_ratio import RatioRules, quality_rules

#: The order of the stages and their sequential or byte-wise parts have no SQL form; the tests compare with brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules(docs, table(spark, sf_dir, "labels"), RatioRules()).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Rows with equal id and text are one document. Different texts under one id stay together.
    """
    prepare(spark)
    first = jaccard_join(docs).filter("doc_id <=> component_id").select("doc_id").distinct()
    stay = docs.join(first.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    return stay.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that also start elsewhere; texts of which nothing is left go."""
    prepare(spark)
    left = remove_repeats(docs)
    # a cut may split a character: what is left of it goes
    whole = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�+", "")
    left = left.withColumn("text", F.when(F.col("n_removed") > 0, whole).otherwise(F.col("text")))
    return left.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    prepare(spark)
    return redact(scan_history(docs)).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 2048 words."""
    prepare(spark)
    return pack_texts(docs, rules=PackRules(2048))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
