"""Language ID by rank-order profiles of letter n-grams.

A profile is the list of a text's most frequent n-grams, most frequent first. A text gets the language whose
profile is nearest by out-of-place distance: the sum, over the text's profile, of how many places each n-gram
is away from its place in the language's profile, or the profile's length where that lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import CHUNK, mix

U = np.uint64
SPACE = 32


@dataclass(frozen=True)
class RankRules:
    """n-grams of 1 to ``longest`` letters and word edges, hashed to ``slots`` numbers; ``size`` places a profile.

    More than ``languages`` languages are refused: the profiles are sent to every task.
    """
    longest: int = 3
    slots: int = 1 << 16
    size: int = 300
    languages: int = 256


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its small letter, or a space where it is no letter."""
    if not _letters:
        table = np.full(0x110000, SPACE, dtype=np.uint32)
        for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
            for i in range(start, stop):
                c = chr(i)
                if c.isalpha():
                    table[i] = ord(c.lower()[0])
        _letters.append(table)
    return _letters[0]


def grams(text: str, rules: RankRules) -> Iterator[np.ndarray]:
    """Slots of a text's n-grams, in pieces of about ``CHUNK`` / 4 characters that end between words.

    Other characters than letters are one space; an n-gram has a space at its ends only.
    """
    at, slots = 0, U(rules.slots)
    while at < len(text):
        stop = at + CHUNK // 4
        while True:
            points = letters()[np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            gaps = np.flatnonzero(points == SPACE)
            if stop >= len(text) or len(gaps):
                break
            stop += CHUNK // 4
        if stop < len(text):
            points = points[:gaps[-1] + 1]
        at += len(points)
        points = np.concatenate(([SPACE], points, [SPACE]))
        stay = points != SPACE
        stay[1:] |= stay[:-1]
        stay[0] = True
        points = points[stay].astype(U)
        space = points == SPACE
        out, code = [], points
        inner = np.zeros(len(points), dtype=bool)       # a space between the first and the last letter
        for n in range(1, min(rules.longest, len(points)) + 1):
            m = len(points) - n + 1
            if n == 1:
                out.append(mix(code[~space] + U(1)) % slots)
                continue
            if n > 2:
                inner = inner[:m] | space[n - 2:n - 2 + m]
            code = (code[:m] << U(21)) ^ points[n - 1:]
            out.append(mix(code + U(n))[~inner[:m]] % slots)
        yield np.concatenate(out).astype(np.int64)


def histogram(text: str, rules: RankRules) -> np.ndarray | None:
    """How often a text has each slot; None without letters."""
    total = None
    for g in grams(text, rules):
        if len(g):
            total = np.bincount(g, minlength=rules.slots) + (0 if total is None else total)
    return total


def profile(counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent slots, most frequent first; ties by slot."""
    slots = np.flatnonzero(counts)
    return slots[np.argsort(-counts[slots], kind="stable")[:size]]


def learn(docs: DataFrame, rules: RankRules, text: str, lang: str) -> dict[str, list[int]]:
    """Profile of every language from all n-grams of its texts; a task sends one row per language and slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                slots = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(slots)), pa.array(slots.astype(np.int32)), pa.array(counts[slots])],
                    names=["lang", "slot", "n"])
            held.clear()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = histogram(t, rules)
                if counts is not None:
                    held[name] = counts + held[name] if name in held else counts
            if len(held) > 64:
                yield from told()
        yield from told()

    counted = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).mapInArrow(
        run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "slot"))
    top = counted.withColumn("place", place).filter(F.col("place") <= rules.size)
    rows = top.select("lang", "place", "slot").limit(rules.languages * rules.size + 1).collect()
    if len(rows) > rules.languages * rules.size:
        raise ValueError(f"more than {rules.languages} languages")
    found: dict[str, list[int]] = {}
    for r in sorted(rows):
        found.setdefault(r["lang"], []).append(r["slot"])
    return found


def identify(docs: DataFrame, profiles: dict[str, list[int]], rules: RankRules = RankRules(), *,
             text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of those names are replaced.

    score is 1 less the distance over the largest possible one. A text that is NULL or has no letter, or any
    text when nothing was learned, is ``und`` with score 0.0; equal distances go to the first name. Only ``text`` is
    looked at, so repeated rows agree; an empty table stays empty.
    """
    names = sorted(profiles)
    held = docs.sparkSession.sparkContext.broadcast([profiles[n] for n in names])
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks = np.full((len(names), rules.slots), -1, dtype=np.int16)
        for i, slots in enumerate(held.value):
            ranks[i, slots] = np.arange(len(slots))
        for texts in batches:
            out = []
            for t in texts:
                counts = histogram(t, rules) if isinstance(t, str) and names else None
                if counts is None:
                    out.append(("und", 0.0))
                    continue
                own = profile(counts, rules.size)
                theirs = ranks[:, own]
                away = np.where(theirs < 0, rules.size, np.abs(theirs - np.arange(len(own))))
                far = away.sum(axis=1)
                best = int(np.argmin(far))
                out.append((names[best], 1.0 - float(far[best]) / (rules.size * len(own))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.select(*keep, predicted(text).alias("_p")).select(
        *keep, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text leaves 2 when divided by 4; a NULL key does not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))
