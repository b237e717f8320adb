"""Shared helpers: session settings, row keys, and word hashes of whole Arrow batches."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20          # bytes hashed at once inside a task
BATCH_ROWS = 256         # rows in an Arrow batch: texts can be long

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once per session, unless their path has it."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_visitloom_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-code-")     # only the driver reads it; Spark sends the file on
    context.addPyFile(shutil.make_archive(f"{folder}/visitloom", "zip", root, "visitloom"))
    context._visitloom_sent = True


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (rows are whole texts), adaptive plans, skewed joins split."""
    ship(spark)
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def shield(df: DataFrame, new: tuple[str, ...], *roles: str) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with columns c0, c1, .. whatever they were called; the names to give back; the columns of ``roles``.

    Columns that ``new`` replaces come last and have no name to give back. Names are compared without case, as
    Spark does; among names that differ only in case a role takes the exact one. Dots and repeats do no harm.
    """
    names = df.columns
    gone = {n.lower() for n in new}
    order = [i for i, n in enumerate(names) if n.lower() not in gone]
    inner = {i: f"c{at}" for at, i in enumerate(order + [i for i in range(len(names)) if i not in order])}

    def of(role: str) -> str:
        same = [i for i, n in enumerate(names) if n == role] or [i for i, n in enumerate(names)
                                                                 if n.lower() == role.lower()]
        if not same:
            raise ValueError(f"no column {role}")
        return inner[same[0]]

    plain = df.toDF(*[inner[i] for i in range(len(names))])
    return plain.select(*sorted(inner.values(), key=lambda c: int(c[1:]))), [names[i] for i in order], [of(r) for r in roles]


def row_key(*columns: Column) -> Column:
    """128 bits that stand for the values of a row; NULLs count as values."""
    known = [F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *known).alias("k1"), F.xxhash64(F.lit(2), *known).alias("k2"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * BASE)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


P = 0xD1342543DE82EF95
P_INVERSE = pow(P, -1, 1 << 64)


def running_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[byte] * P**i; a slice's hash is their difference times P**-start."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(values[data] * powers(P, len(data)), out=out[1:])
    return out


def words_of(data: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``; no word goes over a position in ``breaks``."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[breaks] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = solid
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    total = running_hash(data, FOLDED_VALUE if fold else BYTE_VALUE)
    raw = (total[end] - total[start]) * powers(P_INVERSE, len(data) + 1)[start]
    return start, mix(raw + (end - start).astype(U) * BASE)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the rows' offsets in them; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def word_chunks(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, their hashes) for runs of rows of about ``CHUNK`` bytes.

    A longer text comes alone, hashed piece by piece; pieces end at white space.
    """
    data, offsets = text_buffer(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= CHUNK:
            start, hashes = words_of(data[lo:hi], offsets[row:stop + 1] - lo, fold)
            at = np.searchsorted(start, offsets[row:stop + 1] - lo)
            yield row, np.diff(at), hashes
        else:
            parts = [words_of(data[a:b], np.zeros(0, dtype=np.int64), fold)[1] for a, b in pieces(data, lo, hi)]
            hashes = np.concatenate(parts)
            yield row, np.array([len(hashes)]), hashes
        row = stop


def pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Cut [lo, hi) after white space into pieces of about ``CHUNK`` bytes, longer only inside a longer word."""
    while lo < hi:
        cut, end = hi, lo + CHUNK
        while end < hi:
            gaps = np.flatnonzero(IS_SPACE[data[lo:end]])
            if len(gaps):
                cut = lo + int(gaps[-1]) + 1
                break
            end += CHUNK
        yield lo, cut
        lo = cut
