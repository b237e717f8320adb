"""Quality rules: counts of every text, and a log-likelihood ratio of hashed word n-grams.

Only DataFrame functions: nothing here runs Python on the executors.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, shield

SYMBOLS = "[#*$%&|<>]"
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


@dataclass(frozen=True)
class RatioRules:
    """Thresholds. ``buckets`` bounds the model: that many whole numbers reach the driver."""
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2)   # lengths of the n-grams
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: float = 200_000.0     # n-grams of the raw corpus that the trusted side is taken to have seen besides its own
    unit: float = 1e4            # weights are whole numbers of 1/unit nats
    clip: float = 4.0            # a single n-gram counts that many nats at most
    trusted_rows: int = 20_000   # trusted texts: at most so many, those of least hash
    min_ratio: float = -0.08     # mean nats per n-gram below which a text is rejected


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once per row, though ``use`` names it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.coalesce(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), F.array().cast("array<string>"))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes within their text. Most texts have no or few different
    repeated windows and are done by looking these up; the others sort (window, place).
    """
    windows = F.slice(F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))),
                      F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def again(g: Column) -> Column:
        return bound(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))

    def few(g: Column, d: Column) -> Column:
        return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

    def many(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.transform(bound(pairs, lambda s: F.filter(s, lambda x, k: (
            x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))), lambda x: x["i"])

    return bound(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(
        bound(again(g), lambda d: covered(F.when(F.size(d) <= 16, few(g, d)).otherwise(many(g)))))).cast("long")


def base_counts(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for NULL."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOLS)) - 1).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes),
    }


def gram_buckets(hashes: Column, rules: RatioRules) -> Column:
    """Bucket of every run of ``n`` words, for each wanted ``n``."""
    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(hashes, lambda x: F.pmod(x, F.lit(rules.buckets)).cast("int"))
        whole = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
        return F.transform(whole, lambda x, i: F.pmod(
            F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]), F.lit(rules.buckets)).cast("int"))

    return F.concat(*map(runs, rules.orders)) if len(rules.orders) > 1 else runs(rules.orders[0])


def fit_ratio(docs: DataFrame, trusted: Column, rules: RatioRules, text: str = "text") -> list[int]:
    """Weight of every bucket: log of its share in trusted texts over its share in all, clipped and rounded.

    Counts cover every n-gram of every text; each task sends at most one row per bucket and class.
    The trusted side is smoothed towards the raw one, so a small trusted set gives small weights.
    With no trusted text, or no text, all weights are 0.
    """
    grams = docs.select(F.coalesce(trusted, F.lit(False)).alias("good"),
                        F.explode(bound(hashes_of(words_of(F.col(text))), lambda h: gram_buckets(h, rules))).alias("b"))
    rows = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good")).collect()
    n_raw, n_good = sum(r["raw"] for r in rows), sum(r["good"] for r in rows)
    weights = [0] * rules.buckets
    if n_good:
        for r in rows:
            share = r["raw"] / n_raw
            ratio = math.log((r["good"] + rules.prior * share) / (n_good + rules.prior)) - math.log(share)
            weights[r["b"]] = round(max(-rules.clip, min(rules.clip, ratio)) * rules.unit)
    return weights


def score_texts(docs: DataFrame, weights: list[int], rules: RatioRules, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, ratio and kept; columns of those names are replaced.

    ratio is the mean weight of a text's n-grams in nats, 0.0 without words. kept is false where a base
    rule fails (too few words, too many in repeated windows) or the ratio is under ``min_ratio``; a text
    exactly at it stays. NULL and empty texts have counts 0 and fail. Rows are judged alone, so ties and
    repeated rows all get the same answer, and an empty table stays empty. Other columns may have any name.
    """
    plain, names, (source,) = shield(docs, NEW, text)
    keep = plain.columns[:len(names)]
    table = F.from_json(F.lit(json.dumps(weights, separators=(",", ":"))), "array<int>")
    # one-element explodes keep a later filter from being written out in terms of the text again and again
    rows = plain.select(*keep, F.col(source).alias("source"), F.explode(F.array(words_of(F.col(source)))).alias("words"))
    rows = rows.select("*", F.explode(F.array(hashes_of(F.col("words")))).alias("hashes"))
    ratio = bound(gram_buckets(F.col("hashes"), rules), lambda g: F.when(
        F.size(g) > 0, F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b)) / F.size(g)
        / F.lit(rules.unit)).otherwise(F.lit(0.0)))
    rows = rows.select(*keep, *[c.alias(n) for n, c in base_counts(F.col("source"), F.col("words"), F.col("hashes")).items()],
                       ratio.cast("double").alias("ratio"))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return rows.select(*keep, *NEW[:5], failed.alias("base_failed"), "ratio",
                       (~failed & (F.col("ratio") >= rules.min_ratio)).alias("kept")).toDF(*names, *NEW)


def quality_rules(docs: DataFrame, labels: DataFrame, rules: RatioRules = RatioRules(), *,
                  text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fit on ``docs`` (trusted: rated good and not toxic in ``labels``) and judge every row of it.

    The trusted side is a bounded sample of labelled rows, ``trusted_rows``; the raw side is all of ``docs``.
    A row whose key is NULL is never trusted; rows that share a rated key all are.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(
        F.col(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(rules.trusted_rows)
    plain, _, (row, source) = shield(docs, (), key, text)
    # the limit bounds the broadcast, so no text moves; the raw counts still cover every row
    marked = plain.select(row, source).join(F.broadcast(good.withColumn("_good", F.lit(True))),
                                            F.col(row) == F.col("_key"), "left")
    return score_texts(docs, fit_ratio(marked, F.col("_good"), rules, source), rules, text)
