"""How much two explanations (tables ``key, score``) agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import sort_cuts
from ..sources.session import written
from .ordered import ROWS_PER_TASK, positions, running

SPREAD = 1024      # join keys over which the rows of one large tie are dealt


def scores_from_ranking(df: DataFrame, key: str, order: str, **kw) -> DataFrame:
    """A ranking as scores n, n-1, ..., 1."""
    ranked = positions(df, [], [F.col(order), F.col(key)], sort_cuts(df, [order, key]), "_i",
                       total="_n", **kw)
    return ranked.select(F.col(key).alias("key"), (F.col("_n") - F.col("_i")).cast("double").alias("score"))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k keys of largest absolute score; ties go to the smaller key text."""
    if k < 0:
        raise ValueError("k must not be negative")
    return df.orderBy(F.abs("score").desc(), F.col("key").cast("string")).limit(k)


def topk_jaccard(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Jaccard similarity of the two top-k key sets; 1 when both are empty."""
    tagged = (top_k(a, k).select("key", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(top_k(b, k).select("key", F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    keys = tagged.groupBy("key").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return keys.groupBy().agg(F.coalesce(F.try_divide(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)), F.count(F.lit(1))), F.lit(1.0))
        .alias("topk_jaccard"))


def _tie_ranks(scores: DataFrame, **kw) -> DataFrame:
    """(side, s, r, n): mean rank ``r`` of the ``n`` equal scores ``s`` of a side; a row for each different score."""
    counts = scores.groupBy("side", "s").agg(F.count(F.lit(1)).alias("n"))
    ranks = running(counts, ["side"], [F.col("s")], [F.col("s").cast("double")],
                    before={"_b": ("sum", F.col("n"))}, **kw)
    return written(ranks.select("side", "s", (F.col("_b") + (F.col("n") + 1) / 2.0).alias("r"), "n"), "tie-ranks")


def _with_rank(df: DataFrame, ranks: DataFrame, score: str, name: str,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with the rank of its ``score``; rows without a score go.

    Scores of more than ``rows_per_task`` rows are at most ``rows / rows_per_task``: they are broadcast, and
    their rows are dealt over ``SPREAD`` keys of the join with all other ranks, which they do not match.
    """
    large = F.col("n") > rows_per_task
    tied = ranks.filter(large).select(F.col("s").alias("_ts"), F.col("r").alias("_tr"))
    rest = ranks.select(F.col("s").alias("_s"), F.col("r").alias("_r"), F.when(large, -1).otherwise(0).alias("_part"))
    spread = F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int") + 1
    out = df.filter(F.col(score).isNotNull()).join(F.broadcast(tied), F.col(score) == F.col("_ts"), "left")
    out = out.withColumn("_to", F.when(F.col("_ts").isNull(), 0).otherwise(spread))
    out = out.join(rest, (F.col(score) == F.col("_s")) & (F.col("_to") == F.col("_part")), "left")
    return out.select(*df.columns, F.coalesce("_tr", "_r").alias(name))


def average_ranks(df: DataFrame, score: str, name: str, **kw) -> DataFrame:
    """1-based ranks of ``score``; equal scores share their mean rank, however many they are."""
    ranks = _tie_ranks(df.select(F.lit(0).alias("side"), F.col(score).alias("s")).filter("s is not null"), **kw)
    return _with_rank(df, ranks, score, name, **kw)


def shared_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys present in both tables with both scores."""
    return a.select("key", F.col("score").alias("score_a")).join(
        b.select("key", F.col("score").alias("score_b")), "key")


def spearman(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """Rank correlation over shared keys; NULL below two keys or for a constant side.

    Both tables are read once; one count and one ranking serve both sides.
    """
    both = written(shared_scores(a, b).filter("score_a is not null and score_b is not null"), "shared-scores")
    ranks = _tie_ranks(both.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("side"), F.col(c).cast("double").alias("s"))
        for i, c in enumerate(("score_a", "score_b"))]))).select("col.*"), **kw)
    ranked = both
    for side, score, name in ((0, "score_a", "_ra"), (1, "score_b", "_rb")):
        ranked = _with_rank(ranked, ranks.filter(F.col("side") == side), score, name, **kw)
    # corr() raises on a constant side in ANSI mode, so the quotient is spelled out.
    r = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    stats = ranked.groupBy().agg(F.count(F.lit(1)).alias("shared_keys"), r.alias("_r"))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r")))
    defined = (F.col("shared_keys") >= 2) & F.col("_r").isNotNull()
    return stats.select("shared_keys", F.when(defined, clipped).alias("spearman"))


def stability_report(a: DataFrame, b: DataFrame, k: int = 5, **kw) -> DataFrame:
    """One row: k, shared keys, top-k Jaccard, Spearman."""
    left = spearman(a, b, **kw).withColumn("k", F.lit(k))
    right = topk_jaccard(a, b, k).withColumn("k", F.lit(k))
    return left.join(right, "k").select("k", "shared_keys", "topk_jaccard", "spearman")   # one row each
