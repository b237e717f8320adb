"""Removal of long repeated byte strings, by matching statistics from a run-compressed BWT.

Texts are cut so that equal strings meet. Every window of ``length`` bytes has an anchor, the substring of
``anchor`` bytes in it with the least hash; equal windows have equal anchors at equal offsets. A maximal run of
windows with one anchor, and the bytes they cover, is a segment; each window is in exactly one segment, and
equal windows are in segments of equal anchors. Segments with equal bytes are counted, not copied. Where one anchor
has several different segments, these are indexed together: suffixes are sorted, the Burrows-Wheeler transform
is cut into runs, and the longest match of every position with another place is streamed from values
computed at run ends only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, BYTE_VALUE, CHUNK, P_INVERSE, mix, powers, row_key, running_hash, text_buffer
from .shared import kept

U = np.uint64


@dataclass(frozen=True)
class IndexRules:
    """``length``: bytes of a match; ``anchor``: bytes of an anchor. ``batch`` bytes are indexed at once; the
    windows of an anchor with more than ``crowd`` different segments are counted by hash instead, in ranges from coarse
    to fine, which many tasks share. Neither changes the answer."""
    length: int = 200
    anchor: int = 24
    batch: int = 1 << 19
    crowd: int = 64


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost gram of least hash (its high 40 bits) in every run of ``width`` grams."""
    n = len(grams)
    keyed = (grams & ~U(0xFFFFFF)) | np.arange(n, dtype=U)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U)
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n - width + 1], ahead[width - 1:n]) & U(0xFFFFFF)).astype(np.int64)


def segments_of(data: np.ndarray, ends: np.ndarray, rules: IndexRules) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, segment hash) of texts laid end to end; texts end at ``ends``.

    At most 16 MB at once: positions take 24 bits beside the hashes.
    """
    k, length = rules.anchor, rules.length
    windows = len(data) - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, U, U))
    total = running_hash(data, BYTE_VALUE)
    inverse = powers(P_INVERSE, len(data) + 1)
    grams = mix((total[k:] - total[:-k]) * inverse[:len(data) - k + 1])
    at = anchors(grams, length - k + 1)
    broken = np.zeros(windows + 1, dtype=np.int64)          # windows that go over the end of a text
    inner = ends[ends < len(data)]
    np.add.at(broken, np.clip(inner - length + 1, 0, windows), 1)
    np.add.at(broken, np.clip(inner, 0, windows), -1)
    good = np.cumsum(broken[:windows]) == 0
    edge = np.ones(windows, dtype=bool)
    edge[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    start = np.flatnonzero(edge)
    count = np.diff(np.append(start, windows))
    start, count = start[good[start]], count[good[start]]
    end = start + count - 1 + length
    hashes = mix((total[end] - total[start]) * inverse[start] + count.astype(U) * BASE)
    return start, count, grams[at[start]], hashes


def text_segments(data: np.ndarray, offsets: np.ndarray, rules: IndexRules) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window in its text, windows, anchor, segment) for runs of rows; long texts in overlapping pieces."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        for a in range(lo, max(lo + 1, hi), CHUNK):
            b = min(hi, a + CHUNK + rules.length - 1)
            if stop > row + 1:
                b = hi
            start, count, anchor, seg = segments_of(data[a:b], offsets[row + 1:stop + 1] - a, rules)
            owner = row + np.searchsorted(offsets[row + 1:stop], start + a, side="right")
            yield owner, start + a - offsets[owner], count, anchor, seg
            if b == hi:
                break
        row = stop


def repeated_places(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text a mask of the positions whose next ``length`` bytes also start elsewhere in ``texts``.

    Suffixes are sorted by doubling, which gives the transform and its runs. The longest match of a suffix with
    its neighbour in suffix order is computed at run boundaries only. Inside a run both neighbours
    follow the same byte, so the place before has a match longer by one: all other values are streamed in text order.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff" * 9, dtype=np.uint8)
    n = len(data) - 8
    first = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    marks = np.zeros(len(data), dtype=bool)
    marks[first + sizes] = True
    marks[n:] = True
    # ranks by eight bytes; a suffix that meets the end of its text within them is unlike any other
    key, ended = np.zeros(n, dtype=U), np.zeros(n, dtype=bool)
    for i in range(8):
        key = (key << U(8)) | np.where(ended, 0, data[i:n + i]).astype(U)
        ended |= marks[i:n + i]
    order = np.argsort(key, kind="stable")
    ranks = []
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | ended[order[1:]] | ended[order[:-1]]
    step = 8
    while True:
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        ranks.append(rank)
        if fresh.all():
            break
        # only suffixes that are still equal to a neighbour are sorted further
        same = ~fresh
        same[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(same)
        open_ = order[slots]
        later = rank[np.minimum(open_ + step, n - 1)]
        pair = rank[open_] * n + later
        by = np.argsort(pair, kind="stable")
        order[slots] = open_[by]
        pair = pair[by]
        split = np.ones(len(slots), dtype=bool)
        split[1:] = pair[1:] != pair[:-1]
        fresh[slots] |= split
        step *= 2
    before = np.where(order > 0, data[order - 1], 255)
    head = np.ones(n, dtype=bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] == 255)
    heads = np.flatnonzero(head)
    heads = heads[heads > 0]
    x, y = order[heads - 1].copy(), order[heads].copy()
    sampled = np.zeros(len(heads), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 8 << level, ranks[level]
        for _ in range(2 if level == len(ranks) - 1 else 1):
            near = np.flatnonzero((x < n) & (y < n))
            near = near[rank[x[near]] == rank[y[near]]]
            sampled[near] += width
            x[near] += width
            y[near] += width
    live = np.ones(len(heads), dtype=bool)
    for _ in range(7):
        xs, ys = np.minimum(x, n), np.minimum(y, n)
        live &= (data[xs] == data[ys]) & ~marks[xs] & ~marks[ys]
        sampled += live
        x += live
        y += live
    longest, places = np.zeros(n, dtype=np.int64), np.arange(n)
    # the neighbour before is sampled at the heads of runs, the neighbour after at their ends
    for sample, outer in ((order[heads], order[0]), (order[heads - 1], order[-1])):
        known, value = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        known[outer] = True
        known[sample] = True
        value[sample] = sampled
        last = np.maximum.accumulate(np.where(known, places, 0))
        longest = np.maximum(longest, value[last] - (places - last))
    long = longest >= length
    return [long[a:a + s] for a, s in zip(first, sizes)]


SEGMENT = "k1 long, k2 long, start long, windows int, anchor long, seg long"


def _segments(keyed: DataFrame, rules: IndexRules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for owner, start, count, anchor, seg in text_segments(data, offsets, rules):
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start),
                     pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(seg.view(np.int64))], names=["k1", "k2", "start", "windows", "anchor", "seg"])

    return keyed.mapInArrow(run, SEGMENT)


def _cut_out(keyed: DataFrame, wanted: DataFrame, rules: IndexRules) -> DataFrame:
    """The bytes of the wanted segments."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(
        F.struct("start", "windows", "anchor", "seg", "n", "segs")).alias("list"))
    held = keyed.join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(batch)), sizes)
            data, offsets = text_buffer(batch.column(2))
            view = memoryview(data)
            start = flat.field("start").to_numpy()
            end = start + flat.field("windows").to_numpy() + rules.length - 1
            base = offsets[rows]
            pieces = [bytes(view[a:b]) for a, b in zip((base + start).tolist(), (base + end).tolist())]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), flat.field("start"), flat.field("windows"),
                 flat.field("anchor"), flat.field("seg"), flat.field("n"), flat.field("segs"),
                 pa.array(pieces, pa.binary())],
                names=["k1", "k2", "start", "windows", "anchor", "seg", "n", "segs", "bytes"])

    return held.mapInArrow(run, SEGMENT + ", n long, segs long, bytes binary")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


def _indexed(segments: DataFrame, rules: IndexRules) -> DataFrame:
    """(k1, k2, lo, hi): repeated windows of segments that occur once, from the index of whole groups of an anchor."""
    def marks(group: list[tuple]) -> Iterator[tuple]:
        for row, mask in zip(group, repeated_places([r[5] for r in group], rules.length)):
            if row[4] == 1:
                for lo, hi in zip(*_runs(mask[:row[3]])):
                    yield row[0], row[1], row[2] + int(lo), row[2] + int(hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(group: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*marks(group))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "lo", "hi"])

        group, size, current = [], 0, None
        for batch in batches:
            for anchor, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if anchor != current and size >= rules.batch:
                    yield told(group)
                    group, size = [], 0
                current = anchor
                group.append(tuple(row))
                size += len(row[5])
        if group:
            yield told(group)

    placed = segments.repartition("anchor").sortWithinPartitions("anchor")
    return placed.select("anchor", "k1", "k2", "start", "windows", "n", "bytes").mapInArrow(
        run, "k1 long, k2 long, lo long, hi long")


def _in_cells(ranges: DataFrame, width: int, rules: IndexRules) -> DataFrame:
    """Ranges of windows cut into cells: ``width`` neighbouring offsets of the anchor in its window.

    ``first`` is the offset in the first window of a range (NULL: to be found); it falls by one from window to
    window. All windows of a cell hold the bytes around the anchor that make its core: (c1, c2) stand for cell and core,
    (w1, w2) for the first offset and all bytes of the range. Equal windows are in equal cells and have equal cores.
    """
    length, k = rules.length, rules.anchor
    span = length - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(6))
            data, offsets = data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0]
            inverse = powers(P_INVERSE, len(data) + 1)
            totals = running_hash(data, BYTE_VALUE), running_hash(data, mix(BYTE_VALUE))
            count = batch.column(3).to_numpy()
            if batch.column(4).null_count:
                grams = mix((totals[0][k:] - totals[0][:-k]) * inverse[:len(data) - k + 1]) >> U(24)
                first = grams[offsets[:, None] + np.arange(span)].argmin(axis=1)
            else:
                first = batch.column(4).to_numpy()
            low = (first - count + 1) // width
            cells = first // width - low + 1
            row = np.repeat(np.arange(len(batch)), cells)
            cell = (low + cells - 1)[row] - (np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells))
            top = np.minimum(first[row], cell * width + width - 1)
            size = top - np.maximum((first - count + 1)[row], cell * width) + 1
            skip = first[row] - top                             # windows of the row before this range
            a = offsets[row] + skip
            b = a + size + length - 1
            core = a + top - cell * width
            end = a + top + length - np.minimum(cell * width + width - 1, span - 1)
            h = []
            for t in totals:
                h.append(mix((t[end] - t[core]) * inverse[core] + cell.astype(U) * BASE))
            for t in totals:
                h.append(mix((t[b] - t[a]) * inverse[a] + (top * span + size).astype(U) * BASE))
            at = pa.array(row)
            view = memoryview(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(batch.column(2).to_numpy()[row] + skip),
                 pa.array(size, pa.int64()), pa.array(top, pa.int64()), batch.column(5).take(at),
                 pa.array([bytes(view[x:y]) for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                 *[pa.array(x.view(np.int64)) for x in h]], names=names)

    names = ["k1", "k2", "lo", "count", "first", "n", "bytes", "c1", "c2", "w1", "w2"]
    return ranges.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'bytes' else 'long'}" for c in names))


def _counted(segments: DataFrame, rules: IndexRules) -> list[DataFrame]:
    """The same for the anchors of very many segments: ranges of windows are counted in many tasks, from coarse to fine.

    A range whose bytes are found twice is repeated as a whole; a cell whose core has one sort of range needs no
    finer look. What is left is cut into cells of a quarter of the width, down to single windows.
    """
    columns = ("k1", "k2", "lo", "count", "first", "n", "bytes")
    left = segments.select("k1", "k2", F.col("start").alias("lo"), F.col("windows").cast("long").alias("count"),
                           F.lit(None).cast("long").alias("first"), "n", "bytes")
    found, width = [], rules.length - rules.anchor + 1
    while width > 1:
        width = -(-width // 4)
        ranges = kept(_in_cells(left, width, rules), "ranges")
        twice = ranges.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1").select("w1", "w2")
        found.append(ranges.filter("n = 1").join(twice, ["w1", "w2"]).select(
            "k1", "k2", "lo", (F.col("lo") + F.col("count") - 1).alias("hi")))
        if width > 1:
            mixed = ranges.groupBy("c1", "c2").agg(*[f(w).alias(f"{f.__name__}_{w}") for f in (F.min, F.max)
                                                     for w in ("w1", "w2")]).filter(
                "min_w1 <> max_w1 or min_w2 <> max_w2").select("c1", "c2")
            left = ranges.join(mixed, ["c1", "c2"]).groupBy("w1", "w2").agg(
                F.sum("n").alias("n"), F.min(F.struct(*[c for c in columns if c != "n"])).alias("at")).select("at.*", "n")
            left = left.select(*columns)
    return found


def repeated_windows(keyed: DataFrame, rules: IndexRules) -> DataFrame:
    """(k1, k2, lo, hi): ranges of starts of windows that also start elsewhere."""
    segments = kept(_segments(keyed, rules), "segments")
    different = segments.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"))
    different = kept(different.join(different.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("segs"), F.sum("n").alias("all")).filter("all > 1").select("anchor", "segs"),
        "anchor"), "different")
    placed = segments.join(different, ["anchor", "seg"])
    whole = placed.filter("n > 1").select("k1", "k2", F.col("start").alias("lo"),
                                          (F.col("start") + F.col("windows") - 1).alias("hi"))
    one = placed.filter("segs > 1").groupBy("anchor", "seg", "n", "segs").agg(
        F.min(F.struct("k1", "k2", "start", "windows")).alias("at")).select("at.*", "anchor", "seg", "n", "segs")
    cut = kept(_cut_out(keyed, one, rules), "cut")
    small = _indexed(cut.filter(F.col("segs") <= rules.crowd), rules)
    out = whole.unionByName(small)
    for part in _counted(cut.filter(F.col("segs") > rules.crowd), rules):
        out = out.unionByName(part)
    return kept(out, "windows")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                   rules: IndexRules = IndexRules()) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans and kept (bytes); columns of those names are replaced.

    Every byte that a string of ``length`` bytes covers which also starts elsewhere, in any row or at another
    place of the same one, is removed; all copies lose it, overlapping ones too. spans are the maximal removed
    runs as (start, end) in bytes. Rows that are equal in key and text count as so many places. NULL
    and empty texts have 0 bytes and keep an empty string; NULL keys are kept. An empty table stays empty.
    Segments and windows are compared by hashes of 128 bits in all.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    keep = [c for c in docs.columns if c not in new]
    whole = docs.select(*keep, row_key(F.col(key), F.col(text)).alias("_key")).select(
        *keep, F.col("_key.k1").alias("_k1"), F.col("_key.k2").alias("_k2"))
    keyed = whole.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    windows = repeated_windows(keyed, rules)
    ranges = windows.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    found = whole.join(ranges.hint("shuffle_hash"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    at = found.columns.index(text)
    length = rules.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            lists = batch.column(len(keep))
            sizes, removed, spans, left = [], [], [], []
            for i in range(len(batch)):
                part = data[offsets[i]:offsets[i + 1]]
                sizes.append(len(part))
                ranges = lists[i].values
                if ranges is None or not len(ranges):
                    removed.append(0)
                    spans.append([])
                    left.append(part.tobytes())
                    continue
                cover = np.zeros(len(part) + 1, dtype=np.int64)
                np.add.at(cover, ranges.field("lo").to_numpy(), 1)
                np.add.at(cover, ranges.field("hi").to_numpy() + length, -1)
                mask = np.cumsum(cover[:-1]) > 0
                removed.append(int(mask.sum()))
                spans.append([{"start": int(a), "end": int(b) + 1} for a, b in zip(*_runs(mask))])
                left.append(part[~mask].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, kind), pa.array(left, pa.binary())], names=[*keep, *new])

    fields = [f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep]
    return found.select(*keep, "_ranges").mapInArrow(run, ", ".join(
        [*fields, "n_bytes long", "n_removed long", "spans array<struct<start: long, end: long>>", "kept binary"]))
