"""Classification metrics of a predictions table ``y, p``, per group or overall.

All start from counts per distinct score, made with map-side combine.  Ties
therefore count once, and only as many rows as there are distinct scores reach
the running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import falling_cut, number_or_null
from ..sources.session import written
from .ordered import ROWS_PER_TASK, running

# The default thresholds tried for the best F1.
F1_CANDIDATES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
                 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def defined(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows with a score, neither NULL nor NaN, and a label 0 or 1; all metrics are over these."""
    return df.filter(number_or_null(F.col(p)).isNotNull() & F.col(y).isin(0, 1))


def score_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives per group and distinct score; a NULL or NaN score is no score and is left out.

    ``undefined_scores`` counts what is left out.
    """
    return defined(df, y, p).groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def undefined_scores(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Rows, and rows without a defined score or label, per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(number_or_null(F.col(p)).isNull()).alias("n_no_score"),
        F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).alias("n_no_label"))


def cumulative_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", *,
                      rows_per_task: int = ROWS_PER_TASK, bounded: bool = False) -> DataFrame:
    """Counts per score, positives and negatives above each score, and the group totals."""
    counts = score_counts(df, by, y, p)
    if not bounded:
        counts = written(counts, "score-counts")   # groups are counted first; the scores are made once
    return running(
        counts, by, [F.col("p").desc()], [falling_cut(F.col("p"))],
        before={"tp0": ("sum", F.col("pos")), "fp0": ("sum", F.col("neg"))},
        group={"all_pos": ("sum", F.col("pos")), "all_neg": ("sum", F.col("neg"))},
        rows_per_task=rows_per_task, bounded=bounded, at_most=counts)


def roc_points(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", **kw) -> DataFrame:
    """``threshold, tp, fp, tpr, fpr`` per distinct score, and the origin with a NULL threshold."""
    cum = cumulative_counts(df, by, y, p, **kw).filter("all_pos > 0 AND all_neg > 0")
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    points = cum.select(*by, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                        (tp / F.col("all_pos")).alias("tpr"), (fp / F.col("all_neg")).alias("fpr"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    origin = (score_counts(df, by, y, p).groupBy(*by)
              .agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).filter("all_pos > 0 AND all_neg > 0")
              .select(*by, none.alias("threshold"), zero.alias("tp"), zero.alias("fp"),
                      F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")))
    return points.unionByName(origin)


def pr_points(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", **kw) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the anchor (recall 0, precision 1)."""
    cum = cumulative_counts(df, by, y, p, **kw).filter("all_pos > 0")
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    points = cum.select(*by, F.col("p").alias("threshold"), (tp / (tp + fp)).alias("precision"),
                        (tp / F.col("all_pos")).alias("recall"))
    anchor = (score_counts(df, by, y, p).groupBy(*by).agg(F.sum("pos").alias("all_pos")).filter("all_pos > 0")
              .select(*by, F.lit(None).cast("double").alias("threshold"),
                      F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))
    return points.unionByName(anchor)


def _auroc() -> Column:
    """Area under the ROC steps: each negative counts the positives above it, ties half."""
    area = F.sum(F.col("neg") * (F.col("tp0") + F.col("pos") / 2.0))
    p, n = F.max("all_pos"), F.max("all_neg")
    return F.when((p > 0) & (n > 0), area / (p.cast("double") * n))


def _auprc() -> Column:
    """Trapezoids over recall.  Until the first positive the curve stands at the anchor, precision 1."""
    tp0, fp0, pos, neg = (F.col(c) for c in ("tp0", "fp0", "pos", "neg"))
    here = (tp0 + pos) / (tp0 + pos + fp0 + neg)
    before = F.when(tp0 == 0, 1.0).otherwise(tp0 / F.when(tp0 > 0, tp0 + fp0))
    area = F.sum(pos * (here + before) / 2.0)
    p, n = F.max("all_pos"), F.max("all_neg")
    return F.when((p > 0) & (n > 0), area / p)


def auroc(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", **kw) -> DataFrame:
    """Area under the ROC curve per group; NULL when a group has one class."""
    cum = cumulative_counts(df, by, y, p, **kw)
    return cum.groupBy(*by).agg(_auroc().alias("auroc"))


def auprc(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", **kw) -> DataFrame:
    """Area under the precision-recall curve per group; NULL when a group has one class."""
    cum = cumulative_counts(df, by, y, p, **kw)
    return cum.groupBy(*by).agg(_auprc().alias("auprc"))


def _confusion(threshold: float, pos: Column, neg: Column, p: Column) -> dict[str, Column]:
    hit = p >= threshold
    return {"TP": F.sum(F.when(hit, pos).otherwise(0)), "FP": F.sum(F.when(hit, neg).otherwise(0)),
            "TN": F.sum(F.when(hit, 0).otherwise(neg)), "FN": F.sum(F.when(hit, 0).otherwise(pos))}


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, specificity and F1; NULL where a denominator is 0."""
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "specificity": F.try_divide(tn, tn + fp),
        "f1": F.try_divide(2 * precision * recall, precision + recall)}


def confusion(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), y: str = "y",
              p: str = "p") -> DataFrame:
    """TP, FP, TN and FN at ``p >= threshold`` over the defined rows."""
    pos, neg = (F.col(y) == 1).cast("long"), (F.col(y) == 0).cast("long")
    counts = _confusion(threshold, pos, neg, F.col(p))
    return defined(df, y, p).groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])


def threshold_rates(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), y: str = "y",
                    p: str = "p") -> DataFrame:
    """Confusion counts and the rates that follow from them."""
    c = confusion(df, threshold, by, y, p)
    return c.withColumns(rates(*[F.col(n) for n in ("TP", "FP", "TN", "FN")]))


def brier(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Mean squared error of the probabilities over the defined rows."""
    return defined(df, y, p).groupBy(*by).agg(F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("brier"))


def metric_row(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), y: str = "y", p: str = "p",
               prefix: str = "", **kw) -> DataFrame:
    """Every metric of a group in one row, from one pass over counts per score."""
    cum = cumulative_counts(df, by, y, p, **kw)
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("p")
    squares = F.sum(pos * F.pow(1 - score, 2) + neg * F.pow(score, 2))
    row = cum.groupBy(*by).agg(
        _auroc().alias("auroc"), _auprc().alias("auprc"), F.try_divide(squares, F.sum(pos + neg)).alias("brier"),
        *[c.alias(n) for n, c in _confusion(threshold, pos, neg, score).items()],
        F.sum(pos).alias("n_positive"), F.sum(neg).alias("n_negative"))
    r = rates(*[F.col(n) for n in ("TP", "FP", "TN", "FN")])
    columns = {
        "auroc": F.col("auroc"), "auprc": F.col("auprc"), **r, "brier": F.col("brier"),
        **{n: F.col(n) for n in ("TP", "FP", "TN", "FN")},
        "threshold": F.lit(float(threshold)), "n_samples": F.col("n_positive") + F.col("n_negative"),
        "n_positive": F.col("n_positive"), "n_negative": F.col("n_negative")}
    return row.select(*by, *[c.alias(prefix + n) for n, c in columns.items()])


def f1_by_threshold(df: DataFrame, candidates: Sequence[float] = F1_CANDIDATES, by: Sequence[str] = (),
                    y: str = "y", p: str = "p") -> DataFrame:
    """F1 at every candidate threshold.

    A row adds to one count, the number of candidates it reaches, so the rows are
    read once and not once per candidate; the counts are then summed from the top.
    Rows without a score or a label count nowhere.
    """
    levels = sorted(candidates)
    reached = F.lit(0)
    for c in levels:
        reached = reached + (F.col(p) >= c).cast("int")
    per = defined(df, y, p).groupBy(*by, reached.alias("_level")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    pos, neg = F.col("_pos"), F.col("_neg")
    sums = per.groupBy(*by).agg(
        F.sum(pos).alias("_all"),
        F.array(*[F.struct(F.lit(float(c)).alias("threshold"),
                           F.sum(F.when(F.col("_level") > i, pos).otherwise(0)).alias("tp"),
                           F.sum(F.when(F.col("_level") > i, neg).otherwise(0)).alias("fp"))
                  for i, c in enumerate(levels)]).alias("_c"))
    flat = sums.select(*by, "_all", F.inline("_c"))
    f1 = rates(F.col("tp"), F.col("fp"), F.lit(0), F.col("_all") - F.col("tp"))["f1"]
    return flat.select(*by, "threshold", f1.alias("f1"))


def best_f1_threshold(df: DataFrame, candidates: Sequence[float] = F1_CANDIDATES, by: Sequence[str] = (),
                      y: str = "y", p: str = "p") -> DataFrame:
    """Threshold with the highest F1, the lowest on ties; NULL when F1 is never defined."""
    scored = f1_by_threshold(df, candidates, by, y, p)
    key = F.struct(F.col("f1"), -F.col("threshold"))
    return scored.groupBy(*by).agg(
        F.max_by("threshold", F.when(F.col("f1").isNotNull(), key)).alias("threshold"),
        F.max("f1").alias("f1"))
