"""Removal of token windows that an earlier document has too, by Rabin-Karp hashes counted in Spark.

Every window of ``width`` words gets a rolling polynomial hash, and so has its seed, the run of ``seed`` words in it of
least hash. Neighbouring windows with one seed in one place are a run; its hash rolls over all its words. Equal
windows have equal seeds at equal offsets, so they can only be in runs of one seed. Counting goes from coarse to fine:

* seeds that one document alone has hold no repeated window,
* equal runs are counted as one row with their least document: all later documents lose the whole run,
* where a seed has several different runs, each of their windows is counted by its own hash.

Each count is a partial aggregate before its shuffle. Repeated windows come back as bits of their run and are
merged into maximal intervals of words when the text is rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, P, P_INVERSE, mix, powers, prepare, shield, text_buffer, word_chunks
from .shared import Scratch, tidy

U = np.uint64


@dataclass(frozen=True)
class WindowRules:
    """``width`` words make a window; ``seed`` words a seed. The seed's width changes the work, not the answer."""
    width: int = 13
    seed: int = 5

    def __post_init__(self) -> None:
        if not 1 <= self.seed <= self.width or self.width - self.seed >= 62:
            raise ValueError("a seed has 1 to width words, and at most 62 windows share one")


def rolling(total: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the words start .. start + size - 1, from the running sums of word * P**place."""
    raw = (total[start + size] - total[start]) * powers(P_INVERSE, len(total))[start]
    return mix(raw + np.asarray(size).astype(U) * BASE)


def sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * powers(P, len(words)), out=out[1:])
    return out


def runs_of(words: np.ndarray, sizes: np.ndarray, rules: WindowRules) -> tuple[np.ndarray, ...]:
    """(text, first window in it, windows, seed hash, run hash) for texts of ``sizes`` words laid end to end."""
    windows = len(words) - rules.width + 1
    ends = np.cumsum(sizes)
    if windows <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, U, U))
    total = sums(words)
    grams = rolling(total, np.arange(len(words) - rules.seed + 1), rules.seed)
    near = np.lib.stride_tricks.sliding_window_view(grams, rules.width - rules.seed + 1)
    at = near.argmin(axis=1) + np.arange(windows)
    text = np.searchsorted(ends, np.arange(windows), side="right")
    whole = np.arange(windows) + rules.width <= ends[text]
    edge = np.ones(windows, dtype=bool)
    edge[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(edge)
    count = np.diff(np.append(start, windows))
    start, count = start[whole[start]], count[whole[start]]
    owner = text[start]
    return (owner, start - (ends - sizes)[owner], count, grams[at[start]],
            rolling(total, start, count + rules.width - 1))


def _runs(keyed: DataFrame, rules: WindowRules) -> DataFrame:
    kind = keyed.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sizes, words in word_chunks(batch.column(2), fold=False):
                owner, start, count, seed, whole = runs_of(words, sizes, rules)
                rows = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["doc", "row", "start", "n", "seed", "run"])

    return keyed.mapInArrow(run, f"doc {kind}, row long, start int, n int, seed long, run long")


def _windows(keyed: DataFrame, runs: DataFrame, rules: WindowRules) -> DataFrame:
    """(seed, run, place in it, window hash, doc) for the first place of every given run."""
    kind = keyed.schema["doc"].dataType.simpleString()
    lists = runs.groupBy("at.doc", "at.row").agg(F.collect_list(F.struct(
        F.col("at.start").alias("start"), "n", "seed", "run")).alias("list"))
    held = keyed.join(lists.hint("shuffle_hash"), ["doc", "row"]).select("doc", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            first, count = (flat.field(f).to_numpy().astype(np.int64) for f in ("start", "n"))
            seed, whole = flat.field("seed").to_numpy(), flat.field("run").to_numpy()
            for row, sizes, words in word_chunks(batch.column(1), fold=False):
                lo, hi = bounds[row], bounds[row + len(sizes)]
                owner = np.repeat(np.arange(len(sizes)), np.diff(bounds[row:row + len(sizes) + 1]))
                n = count[lo:hi]
                which = np.repeat(np.arange(lo, hi), n)
                place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat((np.cumsum(sizes) - sizes)[owner] + first[lo:hi], n) + place
                hashes = rolling(sums(words), start, rules.width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[which]), pa.array(whole[which]), pa.array(place.astype(np.int32)),
                     pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(row + np.repeat(owner, n)))],
                    names=["seed", "run", "place", "window", "doc"])

    return held.mapInArrow(run, f"seed long, run long, place int, window long, doc {kind}")


def copied_windows(keyed: DataFrame, rules: WindowRules, room: Scratch) -> DataFrame:
    """(doc, row, start, bits): windows start + i, for every set bit i, also start in a document of smaller ``doc``."""
    every = room.kept(_runs(keyed, rules))
    spread = every.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    shared = room.kept(every.join(spread.select("seed"), "seed", "left_semi"))
    room.drop(every)
    runs = room.kept(shared.groupBy("seed", "run", "n").agg(
        F.min(F.struct("doc", "row", "start")).alias("at"), F.max("doc").alias("last")))
    mixed = runs.groupBy("seed").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("seed")
    windows = room.kept(_windows(keyed, runs.join(mixed, "seed", "left_semi"), rules))
    first = windows.groupBy("seed", "window").agg(F.min("doc").alias("first"))
    bits = windows.join(first, ["seed", "window"]).filter("doc > first").groupBy("seed", "run").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("some"))
    verdicts = runs.select("seed", "run", F.col("at.doc").alias("first"), "last").join(
        bits, ["seed", "run"], "left").filter("last > first or some is not null")
    found = shared.join(verdicts, ["seed", "run"]).select("doc", "row", "start", F.when(
        F.col("doc") > F.col("first"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("some")).alias("bits"))
    found = room.kept(found.filter("bits is not null"))
    room.drop(shared, runs, windows)
    return found


def covered(n: int, start: np.ndarray, bits: np.ndarray, rules: WindowRules) -> np.ndarray:
    """Which of ``n`` words the marked windows cover."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for i in range(rules.width - rules.seed + 1):
        on = start[(bits >> i) & 1 == 1] + i
        np.add.at(steps, on, 1)
        np.add.at(steps, on + rules.width, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_copied_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                          rules: WindowRules = WindowRules()) -> DataFrame:
    """``docs`` with n_words, n_removed, spans and kept (the words left, joined by one space).

    Words are runs of other characters than space and U+0009 to U+000D, compared as they are. A word goes if a window of
    ``width`` words of one row covers it whose words also start in a row of smaller ``key``; windows are judged
    on the input. spans are the maximal removed intervals (start, end) in words. Rows of equal key do not take from
    each other; equal rows have equal results. Rows without a key lose nothing and take nothing. NULL and empty
    texts have no words and keep an empty string; texts under ``width`` words stay whole. An empty table stays
    empty. Columns named as the new ones, in any case, are replaced. Runs and windows are compared by 128 bits.
    """
    new = ("n_words", "n_removed", "spans", "kept")
    tidy(prepare(docs.sparkSession))
    inner, names, (doc, body) = shield(docs, new, key, text)
    room = Scratch(docs.sparkSession, "window-repeats")
    row = F.xxhash64(F.coalesce(F.col(body), F.lit("")))
    keyed = inner.filter(F.col(doc).isNotNull() & F.col(body).isNotNull()).select(
        F.col(doc).alias("doc"), row.alias("row"), F.col(body).alias("text"))
    found = copied_windows(keyed, rules, room)
    lists = found.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_set(F.struct("start", "bits")).alias("_list"))
    keep = [f"c{i}" for i in range(len(names))]
    placed = inner.select(*keep, F.col(doc).alias("_d"), row.alias("_r"), F.col(body).alias("_text"))
    whole = placed.join(lists.hint("shuffle_hash"), (F.col("_d") == F.col("_doc")) & (F.col("_r") == F.col("_row")),
                        "left").select(*keep, "_text", "_list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            view, lists = memoryview(data), batch.column(len(keep) + 1)
            sizes, removed, spans, left = [], [], [], []
            for i in range(len(batch)):
                words = bytes(view[offsets[i]:offsets[i + 1]]).split()
                marks, gone = lists[i].values, []
                if marks is not None and len(marks):
                    mask = covered(len(words), marks.field("start").to_numpy().astype(np.int64),
                                   marks.field("bits").to_numpy(), rules)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
                    gone = list(zip(edge[::2], edge[1::2]))
                    words, n = [w for w, m in zip(words, mask.tolist()) if not m], len(words)
                else:
                    n = len(words)
                sizes.append(n)
                removed.append(n - len(words))
                spans.append([{"start": a, "end": b} for a, b in gone])
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, kind), pa.array(left, pa.binary()).cast(pa.string())], names=[*keep, *new])

    fields = [f"{c} {whole.schema[c].dataType.simpleString()}" for c in keep]
    return whole.mapInArrow(run, ", ".join([*fields, "n_words long", "n_removed long",
                            "spans array<struct<start: long, end: long>>", "kept string"])).toDF(*names, *new)
