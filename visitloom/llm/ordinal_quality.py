"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w . x) with one weight vector w over hashed words for all grades and
thresholds in increasing order. The expected grade and the probability of a high grade rank and select texts; the
probability from which a text is selected comes from rated rows outside the fold that was fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, text_buffer, word_chunks

U = np.uint64


@dataclass(frozen=True)
class OrdinalRules:
    """``buckets`` word features and a few for the text's form; fitted on at most ``sample`` rated rows, those of
    least hash, by ``steps`` of gradient descent; words of fewer than ``rows`` of these rows have no weight. A text is
    selected from the probability of the highest grade that a share ``stay`` of the rows of this grade reaches when
    each of ``folds`` parts is judged by a fit on the others."""
    buckets: int = 1 << 18
    sample: int = 12_000
    rows: int = 5
    steps: int = 400
    rate: float = 0.5
    decay: float = 1e-4
    folds: int = 3
    stay: float = 0.97


@dataclass(frozen=True)
class OrdinalModel:
    """``least`` is the probability of the highest grade from which a text is selected, ``rates`` the share of the rows of
    each grade, held out from the fit, that reach it."""
    weights: np.ndarray
    thresholds: np.ndarray
    least: float = 0.35
    rates: tuple[float, ...] = ()

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every text and threshold."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -40, 40)
        return 1 / (1 + np.exp(-z))


def features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every row its buckets and their values: shares of words, scaled to length 1 with a constant 0.5 weight
    for each of four form features (many repeats, symbols, capitals, short)."""
    data, offsets = text_buffer(column)
    for row, counts, words in word_chunks(column):
        kinds = (mix(words + U(7)) % U(buckets)).astype(np.int64)
        at = 0
        for i, n in enumerate(counts):
            slots, times = np.unique(kinds[at:at + n], return_counts=True)
            at += n
            part = data[offsets[row + i]:offsets[row + i + 1]]
            size = max(1, len(part))
            caps = np.count_nonzero((part >= 65) & (part <= 90)) / size
            marks = np.count_nonzero((part >= 33) & (part <= 64)) / size
            form = np.array([1 - len(slots) / max(1, n), min(1.0, 4 * marks), caps, 1 / np.sqrt(1 + n)])
            value = np.sqrt(times)
            value /= max(1e-9, np.sqrt((value ** 2).sum()))
            yield np.concatenate((slots, buckets + np.arange(4))), np.concatenate((value, form))


def fit(rated: DataFrame, rules: OrdinalRules, *, text: str = "text", grade: str = "grade") -> OrdinalModel:
    """Fit on at most ``rules.sample`` rows with a grade 0, 1, 2, ..; the features of these reach the driver.

    The fit on all rows is the model; fits without each part give its cut and the rates. With fewer than two grades all
    weights are 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = zip(*features(batch.column(0), rules.buckets)) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for v in values], pa.list_(pa.float32())), batch.column(1)],
                names=["slots", "values", "grade"])

    sample = rated.filter(F.col(grade).isNotNull()).select(text, F.col(grade).cast("int").alias("grade"))
    rows = sample.mapInArrow(run, "slots array<int>, values array<float>, grade int").toArrow()
    size = rules.buckets + 4
    if not len(rows):
        return OrdinalModel(np.zeros(size), np.zeros(0))
    y = rows.column("grade").to_numpy()
    grades = int(y.max()) + 1
    if len(np.unique(y)) < 2:
        return OrdinalModel(np.zeros(size), np.zeros(grades - 1))
    lists = rows.column("slots").combine_chunks()
    n_of = np.diff(lists.offsets.to_numpy())
    slots = lists.flatten().to_numpy()
    values = rows.column("values").combine_chunks().flatten().to_numpy().astype(np.float64)
    owner = np.repeat(np.arange(len(y)), n_of)
    part = np.bincount(owner, slots, minlength=len(y)).astype(np.int64) % rules.folds     # equal texts are in one part
    top = np.full(len(y), np.nan)
    for i in range(rules.folds):
        out = part == i
        if len(np.unique(y[~out])) < 2 or not out.any():
            continue
        model = _descend(y, slots, values, owner, ~out, grades, rules)
        score = np.bincount(owner, model.weights[slots] * values, minlength=len(y))
        top[out] = model.tails(score[out])[:, -1]
    model = _descend(y, slots, values, owner, np.ones(len(y), dtype=bool), grades, rules)
    best = top[(y == grades - 1) & ~np.isnan(top)]
    if not len(best):
        return model
    # two standard errors below the wanted place: with few rows the cut is looser, so that clean rows stay
    lost, n = 1 - rules.stay, len(best)
    least = float(np.sort(best)[max(0, int(n * lost - 2 * np.sqrt(n * lost * rules.stay)))])
    judged = [top[(y == g) & ~np.isnan(top)] for g in range(grades)]
    return replace(model, least=least, rates=tuple(float((t >= least).mean()) if len(t) else 0.0 for t in judged))


def _descend(y: np.ndarray, slots: np.ndarray, values: np.ndarray, owner: np.ndarray, use: np.ndarray, grades: int,
             rules: OrdinalRules) -> OrdinalModel:
    """Fit on the rows in ``use``.

    A feature is scaled by how far the shares of rows that have it differ between the highest grade and another (log of
    their quotient), so rare strong words are not lost among the many words of a long text.
    """
    size = rules.buckets + 4
    mine = use[owner]
    slots, values, owner, y = slots[mine], values[mine], (np.cumsum(use) - 1)[owner[mine]], y[use]
    known = np.bincount(slots, minlength=size)[slots] >= rules.rows
    slots, values, owner = slots[known], values[known], owner[known]
    share = [np.log((np.bincount(slots[y[owner] == g], minlength=size) + 1) / (np.count_nonzero(y == g) + 2))
             for g in range(grades)]
    scale = np.maximum(0.05, np.max([abs(x - share[-1]) for x in share[:-1]], axis=0))
    scale[rules.buckets:] = 1
    values = values * scale[slots]
    weight = np.full(len(y), 1 / len(y))
    w, gaps = np.zeros(size), np.log(np.expm1(np.ones(grades - 1)))
    first = -(grades - 1) / 2
    sums = [np.full(size, 1e-8), 1e-8, np.full(grades - 1, 1e-8)]
    for _ in range(rules.steps):
        theta = first + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(gaps[1:])))))
        score = np.bincount(owner, w[slots] * values, minlength=len(y))
        upper = np.append(theta, 40.0)[y]
        lower = np.insert(theta, 0, -40.0)[y]
        fu, fl = (1 / (1 + np.exp(-np.clip(t - score, -40, 40))) for t in (upper - score, lower - score))
        p = np.maximum(fu - fl, 1e-9)
        du, dl = fu * (1 - fu) / p * weight, fl * (1 - fl) / p * weight
        g_w = np.bincount(slots, ((du - dl)[owner]) * values, minlength=size) + rules.decay * w
        g_theta = np.bincount(y, -du, minlength=grades)[:grades - 1] + np.bincount(y, dl, minlength=grades)[1:]
        g_first = g_theta.sum()
        g_gaps = np.concatenate(([0.0], np.cumsum(g_theta[::-1])[::-1][1:] / (1 + np.exp(-gaps[1:]))))
        for i, g in enumerate((g_w, g_first, g_gaps)):
            sums[i] = sums[i] + g ** 2
        w -= rules.rate * g_w / np.sqrt(sums[0])
        first -= rules.rate * 0.2 * g_first / np.sqrt(sums[1])
        gaps -= rules.rate * 0.2 * g_gaps / np.sqrt(sums[2])
    theta = first + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(gaps[1:])))))
    return OrdinalModel(w * scale, theta)


def grade_texts(docs: DataFrame, model: OrdinalModel, rules: OrdinalRules = OrdinalRules(), *,
                text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_top`` and ``selected``; columns of those names are replaced.

    expected_grade is the sum of P(grade > j), p_top the probability of the highest grade, selected says whether
    it is ``model.least`` or more. NULL and empty texts are graded as a text without words. Texts are
    graded alone: repeated rows agree, an empty table stays empty. A model of one grade gives 0 and 1.
    """
    new = ("expected_grade", "p_top", "selected")
    keep = [c for c in docs.columns if c not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)     # buckets + a few numbers

    @F.pandas_udf("expected_grade double, p_top double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            column = pa.array([t if isinstance(t, str) else None for t in texts], pa.string())
            score = np.array([float(m.weights[s] @ v) for s, v in features(column, rules.buckets)])
            tails = m.tails(score.reshape(-1))
            top = tails[:, -1] if tails.shape[1] else np.ones(len(texts))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_top": top})

    return docs.select(*keep, graded(text).alias("_g")).select(
        *keep, F.col("_g.expected_grade").alias("expected_grade"), F.col("_g.p_top").alias("p_top"),
        (F.col("_g.p_top") >= model.least).alias("selected"))


def rated_rows(docs: DataFrame, labels: DataFrame, rules: OrdinalRules, *, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Texts with a grade: 0 poor, 1 good but toxic, 2 good; at most ``rules.sample`` rows, those of least hash."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    sample = labels.select(F.col(key).alias("_key"), grade.alias("grade")).filter("grade is not null")
    sample = sample.groupBy("_key").agg(F.min("grade").alias("grade")).orderBy(
        F.xxhash64("_key"), "_key").limit(rules.sample)
    return docs.join(F.broadcast(sample), F.col(key) == F.col("_key")).select(text, "grade")
