"""SentencePiece encoding and decoding with a streaming Viterbi search.

A text's best path of pieces (largest sum of scores) is found left to right with a window of the longest
piece: only the positions of the last ``longest`` characters can still start a piece. When the backpointers of all
of them lead through one boundary, no later character can change what lies before it, and its ids are committed.
Where the pieces have no space mark inside, every word start is such a boundary; words are committed one by one
and a bounded memory of earlier words is reused. New words are searched side by side, position by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MARK = "▁"
REMEMBER = 500_000       # words whose ids a task keeps
AT_ONCE = 100_000        # words looked up at once
STEP = 8_192             # new words searched at once


@dataclass
class Pieces:
    """Pieces with scores, ids of the 256 byte pieces, and the id and score of an unknown character."""
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    texts: list[bytes]
    longest: int = 0
    worst: float = 0.0
    joined: bool = False             # whether a piece has a space mark after another character
    known: dict[str, bytes] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)     # made where they are used
    table: tuple = ()

    def __post_init__(self):
        self.longest = max(map(len, self.scores))
        self.worst = min(self.scores.values()) - 10
        self.joined = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)

    def _trie(self) -> dict:
        """Characters to deeper nodes; the score of a piece that ends at a node is under the empty string."""
        if not self.trie:
            for piece, score in self.scores.items():
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = score
        return self.trie

    def path(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the pieces of the best path; of equal paths the one whose last piece starts first.

        The window holds the best score and the backpointer of the positions since the last commit; ``reach`` is
        the farthest position that a piece has reached.
        """
        trie, window, worst, none = self._trie(), 4 * self.longest, self.worst, float("-inf")
        n, base = len(text), 0
        size = min(n, window + self.longest) + 1
        best, back = [none] * size, [0] * size      # of position base + k
        best[0] = 0.0
        for i in range(n):
            k = i - base
            here, node, single, j = best[k], trie, False, k
            for c in text[i:i + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                s = node.get("")
                if s is not None:
                    if j == k + 1:
                        single = True
                    if here + s > best[j]:
                        best[j], back[j] = here + s, i
            if not single and here + worst > best[k + 1]:
                best[k + 1], back[k + 1] = here + worst, i
            if k + 1 >= window and i + 1 < n:
                # a later piece starts at a position that is reached already; follow them all to one boundary
                heads = {p for p in range(i + 1, base + size) if best[p - base] > none}
                while len(heads) > 1:
                    top = max(heads)
                    heads.remove(top)
                    heads.add(back[top - base])
                meet = heads.pop()
                if meet > base:
                    yield from self._trace(back, base, meet)
                    low, gone = best[meet - base], meet - base
                    best = [b - low for b in best[gone:]] + [none] * gone
                    back = back[gone:] + [0] * gone
                    base = meet
                else:                                # no common boundary yet: a wider window
                    best += [none] * window
                    back += [0] * window
                    size += window
                    window *= 2
        yield from self._trace(back, base, n)

    @staticmethod
    def _trace(back: list[int], base: int, end: int) -> list[tuple[int, int]]:
        spans = []
        while end > base:
            spans.append((back[end - base], end))
            end = back[end - base]
        return spans[::-1]

    def ids_of(self, part: str) -> Iterator[int]:
        for a, b in self.path(part):
            piece = self.ids.get(part[a:b])
            if piece is not None:
                yield piece
            elif self.byte_ids:
                yield from (self.byte_ids[x] for x in part[a:b].encode())
            else:
                yield self.unknown

    def _table(self) -> tuple[np.ndarray, ...]:
        """The same trie as arrays: the child of a node by a letter is in the slot ``base[node] + letter`` if ``owner``
        of the slot is that node. ``letter`` numbers the characters of the pieces from 1; others are 0, no child."""
        if not self.table:
            number = {c: i for i, c in enumerate(sorted({c for p in self.scores for c in p}), 1)}
            letter = np.zeros(0x110000, dtype=np.int32)
            letter[[ord(c) for c in number]] = list(number.values())
            nodes, piece, score = [self._trie()], [-1], [self.worst]
            edges, spelled = [], [""]
            for node in nodes:                       # it grows
                kids = {number[c]: kid for c, kid in node.items() if c}
                word = spelled[len(edges)]
                edges.append({c: len(nodes) + i for i, c in enumerate(kids)})
                nodes += kids.values()
                spelled += [word + c for c in node if c]
            for word in spelled[1:]:
                piece.append(self.ids.get(word, -1))
                score.append(self.scores.get(word, 0.0))
            base, used, low = [0] * len(nodes), bytearray(len(number) + 1), len(number) + 1
            filled = []
            for n in sorted(range(len(nodes)), key=lambda n: -len(edges[n])):
                cs, tries, s = sorted(edges[n]), 0, low - 1
                if not cs:
                    break
                while True:                          # the first place where all slots of the node are free
                    s = used.find(0, s + 1)
                    if s < 0:
                        s = len(used)
                    if s + cs[-1] - cs[0] >= len(used):
                        used.extend(bytes(s + cs[-1] - cs[0] + 1 - len(used)))
                    if not any(used[s + c - cs[0]] for c in cs):
                        break
                    tries += 1
                if tries > 20 or len(cs) == 1:      # what lies before is nearly full
                    low = s
                base[n] = s - cs[0]
                for c in cs:
                    used[base[n] + c] = 1
                    filled.append((base[n] + c, n, edges[n][c]))
            owner = np.full(max(base) + len(number) + 1, -1, dtype=np.int32)
            child = np.zeros(len(owner), dtype=np.int32)
            slots, owners, kids = np.array(filled).T
            owner[slots], child[slots] = owners, kids
            self.table = (letter, np.array(base, dtype=np.int32), owner, child, np.array(piece, dtype=np.int32),
                          np.array(score))
        return self.table

    def _learn(self, words: list[str]) -> None:
        """Put the ids of ``path`` of words shorter than the window, which need no commit inside, in ``known``.

        All words take a step at once: the scores that start at their first characters, then at the second ones, and so
        on. Characters and positions have the same numbers, for a word is followed by a gap, its last position.
        """
        letter, base, owner, child, piece, score = self._table()
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), dtype=np.uint32)
        letters = letter[codes]
        letters[ends] = 0
        offset = np.arange(len(codes)) - np.repeat(ends - sizes, sizes + 1)
        starts, node = np.delete(np.arange(len(codes)), ends), np.zeros(len(codes) - len(ends), dtype=np.int32)
        lone = np.ones(len(codes), dtype=bool)       # no piece of this one character
        lone[ends] = False
        found = []                                   # start, end and node of the pieces in the words
        for n in range(1, self.longest + 1):
            slot = base[node] + letters[starts + n - 1]
            fits = owner[slot] == node
            starts, node = starts[fits], child[slot[fits]]
            if not len(starts):
                break
            hit = piece[node] >= 0
            found.append((starts[hit], starts[hit] + n, node[hit]))
            if n == 1:
                lone[starts[hit]] = False
        other = np.flatnonzero(lone)
        found.append((other, other + 1, np.zeros(len(other), dtype=np.int32)))
        start, end, node = map(np.concatenate, zip(*found, strict=True))
        at = offset[start].astype(np.uint16)
        order = np.argsort(at, kind="stable")
        start, end, node = start[order], end[order], node[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=1))))
        best = np.where(offset == 0, 0.0, -np.inf)
        back, last = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int32)
        gain = score[node]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            to, total = end[lo:hi], best[start[lo:hi]] + gain[lo:hi]
            better = total > best[to]
            to = to[better]
            best[to], back[to], last[to] = total[better], start[lo:hi][better], node[lo:hi][better]
        on_path, here = np.zeros(len(codes), dtype=bool), ends
        while len(here):
            on_path[here] = True
            here = back[here]
            here = here[offset[here] > 0]
        path = np.flatnonzero(on_path)
        ids, wide = piece[last[path]], np.ones(len(path), dtype=np.int64)
        strange = ids < 0
        if strange.any():
            odd = codes[back[path[strange]]]
            ids[strange] = self.unknown
            if self.byte_ids:
                wide[strange] = 1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000)
                ids = np.repeat(ids, wide)
                raw = odd.tobytes().decode("utf-32-le").encode()
                ids[np.repeat(strange, wide)] = np.array(self.byte_ids)[np.frombuffer(raw, dtype=np.uint8)]
        stop = np.cumsum(wide)[np.searchsorted(path, ends)] * 4
        flat, lo = ids.astype(np.int32).tobytes(), 0
        for word, hi in zip(words, stop.tolist(), strict=True):
            self.known[word] = flat[lo:hi]
            lo = hi

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of every part; what is not known yet is learnt together."""
        known, out = self.known, []
        for a in range(0, len(parts), AT_ONCE):
            some = parts[a:a + AT_ONCE]
            ids = list(map(known.get, some))
            gaps = [i for i, x in enumerate(ids) if x is None]
            if gaps:
                short = [p for p in {some[i] for i in gaps} if len(p) < 4 * self.longest]
                if len(known) + len(short) > REMEMBER:
                    known.clear()
                for b in range(0, len(short), STEP):
                    self._learn(short[b:b + STEP])
                for i in gaps:
                    ids[i] = known.get(some[i]) or np.fromiter(self.ids_of(some[i]), dtype=np.int32).tobytes()
            out += ids
        return out

    def _parts(self, text: str) -> list[str]:
        """The words of a text with their marks; the whole text where pieces go over a mark."""
        if self.joined:
            return [MARK + text.replace(" ", MARK)]
        if text[0] == " " or "  " in text or MARK in text:       # several marks in a row
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK)).split(" ")

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each whole text. A space is written as the mark, and one comes before the text."""
        parts, sizes = [], []
        for i, text in enumerate(texts, 1):
            own = self._parts(text) if text else []
            parts += own
            sizes.append(len(own))
            if len(parts) >= AT_ONCE or i == len(texts):
                ids, a = self._ids_of_parts(parts), 0
                for n in sizes:
                    yield np.frombuffer(b"".join(ids[a:a + n]), dtype=np.int32)
                    a += n
                parts, sizes = [], []

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        raw = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def read_pieces(path: str) -> Pieces:
    """Pieces and scores of a SentencePiece model file. Nothing is trained.

    The file's scores are used as they are: those of a model of merges are minus the rank of the merge.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids, byte_ids, texts = {}, {}, [0] * 256, []
    some_byte = False
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
            some_byte = True
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            scores[piece], ids[piece] = model.get_score(i), i
            texts.append(piece.replace(MARK, " ").encode())
    return Pieces(scores, ids, byte_ids if some_byte else [], model.unk_id(), texts)


_loaded: dict[str, Pieces] = {}


def _held(spark: SparkSession, path: str):
    """The pieces for the tasks: read on the driver, as large as the model file. Workers keep one copy each."""
    return spark.sparkContext.broadcast((path, read_pieces(path)))


def _pieces(held) -> Pieces:
    path, pieces = held.value
    return _loaded.setdefault(path, pieces)


def encode_texts(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int); a column of that name is replaced.

    NULL text has NULL ids, an empty one none. A character that no piece covers becomes its UTF-8 bytes' pieces, so
    any text without U+2581 decodes to itself. Each text has ids of its own, and whole; memory is
    a batch of texts, its ids, the words looked up at once and the window. Repeated rows agree; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c != "ids"]
    held = _held(docs.sparkSession, model)
    at = docs.select(*keep).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(held)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            ids = pieces.encode_all([t for t in texts if t is not None])
            out = [None if t is None else next(ids) for t in texts]
            sizes = np.array([0 if x is None else len(x) for x in out], dtype=np.int64)
            flat = np.concatenate([x for x in out if x is not None] or [np.zeros(0, dtype=np.int32)])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in out]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids], names=[*keep, "ids"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep).mapInArrow(run, ", ".join([*fields, "ids array<int>"]))


def decode_ids(encoded: DataFrame, model: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``to``; NULL ids have NULL text. Ids outside the model fail."""
    keep = [c for c in encoded.columns if c != to]
    held = _held(encoded.sparkSession, model)
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(held)
        for batch in batches:
            out = [None if not x.is_valid else pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist())
                   for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())],
                                             names=[*keep, to])

    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep]
    return encoded.select(*keep).mapInArrow(run, ", ".join([*fields, f"`{to}` string"]))
