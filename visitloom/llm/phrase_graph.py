"""Phrase mining on a weighted de Bruijn graph of words.

An edge is a run of ``longest`` words inside a piece of text, its nodes are the two runs of one word less. Every word starts
one row: an edge, or, where its piece ends too soon, a shorter run, which is the correction of the node that has no
edge there. Rows are counted in the tasks that read the texts, then dealt out by ranges of their words and sorted, so the
edges that leave a node, of any length, stand together: one pass over the sorted rows adds what flows out of a node
and its corrections, and that is the node's count. Only runs at the ends of a range need a second sum.

Edges that are frequent are joined to paths where the node between two of them has no other way in or out, by pointer
doubling. Paths are the phrases as long as they go; whatever lies inside one is contained in a longer phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BASE, CHUNK, FOLDED_VALUE, P_INVERSE, mix, powers, prepare, running_hash, shield, text_buffer
from .shared import Scratch, tidy

U = np.uint64
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True


@dataclass(frozen=True)
class PhraseRules:
    """Phrases of 2 to ``longest`` words found ``least`` times, the best ``top`` of each language.

    A phrase goes if a longer one around it has ``inside`` percent of its count. The ``coded`` most frequent words
    travel as small numbers, which saves disk only; ``batch`` words are counted in a task at once.
    """
    longest: int = 4
    least: int = 30
    top: int = 2000
    inside: int = 80
    scale: int = 2_000_000
    coded: int = 65_536
    batch: int = 1 << 20

    def __post_init__(self) -> None:
        if self.longest < 3 or self.least < 1:
            raise ValueError("phrases have up to three words or more, and are found at least once")

    @property
    def names(self) -> list[str]:
        return [f"w{i + 1}" for i in range(self.longest)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hash, row, opens a piece) of every word of rows laid end to end."""
    solid = ~GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    before[1:], after[:-1] = solid, solid
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    total = running_hash(data, FOLDED_VALUE)
    raw = (total[end] - total[start]) * powers(P_INVERSE, len(data) + 1)[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.cumsum(BREAK[data])[start]
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    return start, end, mix(raw + (end - start).astype(U) * BASE), row, opens


def spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``CHUNK`` bytes; a longer row comes alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, stop
        row = stop


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, word, n): every word of every text, its hash and how often it is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for row, stop in spans(offsets):
                lo = int(offsets[row])
                part = data[lo:int(offsets[stop])]
                start, end, hashes, _, _ = tokens(part, offsets[row:stop + 1] - lo)
                unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
                view = memoryview(part)
                words = [bytes(view[a:b]).lower() for a, b in zip(start[first].tolist(), end[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(words, pa.binary()),
                                                  pa.array(n.astype(np.int64))], names=["h", "word", "n"])

    found = texts.mapInArrow(run, "h long, word binary, n long")
    return found.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n")).withColumn(
        "word", F.col("word").cast("string"))


def code_of(h: Column) -> Column:
    """The number of a word that has no small one: its hash with the sign bit set."""
    return h.bitwiseOR(F.lit(-(1 << 63)))


def _grams(texts: DataFrame, known: np.ndarray, codes: np.ndarray, rules: PhraseRules) -> DataFrame:
    """(lang, w1 .., n, salt): runs of up to ``longest`` words from every word on, 0 after the end of a piece."""
    size, names = rules.longest, rules.names

    def coded(hashes: np.ndarray) -> np.ndarray:
        out = (hashes | U(1 << 63)).view(np.int64).copy()
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            out[hit] = codes[at[hit]]
        return out

    def summed(parts: list[tuple], langs: list[str], salt: int) -> Iterator[pa.RecordBatch]:
        lang = np.concatenate([p[0] for p in parts])
        words = [np.concatenate([p[1][i] for p in parts]) for i in range(size)]
        half = (size + 1) // 2
        keys = []
        for group in (words[half:], words[:half]):
            key = lang.astype(U)
            for w in group:
                key = mix(key * BASE + w.view(U))
            keys.append(key)
        order = np.lexsort(keys)
        lang, words = lang[order], [w[order] for w in words]
        fresh = np.ones(len(lang), dtype=bool)
        fresh[1:] = lang[1:] != lang[:-1]
        for w in words:
            fresh[1:] |= w[1:] != w[:-1]
        at = np.flatnonzero(fresh)
        n = np.diff(np.append(at, len(lang)))
        table = pa.array(langs, pa.string())
        for a in range(0, len(at), 1 << 16):
            cut = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [table.take(pa.array(lang[cut])), *[pa.array(w[cut]) for w in words],
                 pa.array(n[a:a + (1 << 16)].astype(np.int64)), pa.array(np.full(len(cut), salt, dtype=np.int64))],
                names=["lang", *names, "n", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        ids: dict[str, int] = {}
        parts, held = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            own = np.array([ids.setdefault(x, len(ids)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for row, stop in spans(offsets):
                lo = int(offsets[row])
                _, _, hashes, owner, opens = tokens(data[lo:int(offsets[stop])], offsets[row:stop + 1] - lo)
                if not len(hashes):
                    continue
                word, inside = coded(hashes), np.ones(len(hashes), dtype=bool)
                columns = [word]
                for shift in range(1, size):
                    later = np.zeros(len(word), dtype=np.int64)
                    inside[max(0, len(word) - shift):] = False
                    inside[:len(word) - shift] &= ~opens[shift:]
                    later[:len(word) - shift] = word[shift:]
                    columns.append(np.where(inside, later, 0))
                parts.append((own[row + owner], columns))
                held += len(word)
                if held >= rules.batch:
                    yield from summed(parts, list(ids), (task << 32) + seen)
                    parts, held, seen = [], 0, seen + 1
        if parts:
            yield from summed(parts, list(ids), (task << 32) + seen)

    return texts.mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in [*names, "n", "salt"]))


def _flows(grams: DataFrame, rules: PhraseRules) -> DataFrame:
    """(lang, k, w1 .., n): counts of all runs of k words, for k up to ``longest``; k = 0 counts all words.

    Runs under ``least`` are left out. Runs that reach an end of a task's range may be there in parts.
    """
    size, names = rules.longest, rules.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        open_: list[list] = []          # per length: lang, words, count, whether the run began with the range
        last = None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            langs = list(ids)
            cols = list(zip(*rows)) or [()] * (size + 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in cols[0]], pa.string()), pa.array(cols[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["lang", "k", *names, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column(0).dictionary_encode()
            known = np.array([ids.setdefault(x, len(ids)) for x in kinds.dictionary.to_pylist()], dtype=np.int64)
            cols = [known[kinds.indices.to_numpy()], *[batch.column(1 + i).to_numpy() for i in range(size)]]
            n, out = batch.column(1 + size).to_numpy(), []
            change = np.zeros(len(n), dtype=bool)
            for k in range(size + 1):
                change[1:] |= cols[k][1:] != cols[k][:-1]
                change[0] |= last is None or last[k] != cols[k][0]
                at = np.flatnonzero(change)
                begin = at if change[0] else np.append(0, at)
                total = np.add.reduceat(n, begin)
                if not change[0]:
                    total[0] += open_[k][2]
                first_open = not change[0] and open_[k][3]
                if change[0] and last is not None:
                    was = open_[k]
                    if (was[2] >= rules.least or was[3] or not k) and (not k or was[1][k - 1]):
                        out.append((was[0], k, *was[1], was[2]))
                # all runs but the last are complete
                pick = np.flatnonzero((total[:-1] >= rules.least) & (cols[k][begin[:-1]] != 0 if k else True))
                closed = set(pick.tolist())
                if len(begin) > 1 and (first_open or last is None) and (not k or cols[k][begin[0]]):
                    closed.add(0)
                if not k:
                    closed.update(range(len(begin) - 1))
                for i in sorted(closed):
                    row = begin[i]
                    out.append((int(cols[0][row]), k, *[int(cols[j][row]) if j <= k else 0 for j in range(1, size + 1)],
                                int(total[i])))
                row = begin[-1]
                began = (first_open or last is None) and len(begin) == 1
                now = [int(cols[0][row]), tuple(int(cols[j][row]) if j <= k else 0 for j in range(1, size + 1)),
                       int(total[-1]), began]
                if len(open_) <= k:
                    open_.append(now)
                else:
                    open_[k] = now
            last = [c[-1] for c in cols]
            yield told(out)
        if open_:
            yield told([(w[0], k, *w[1], w[2]) for k, w in enumerate(open_) if not k or w[1][k - 1]])

    ordered = grams.repartitionByRange("lang", *names, "salt").sortWithinPartitions("lang", *names)
    return ordered.select("lang", *names, "n").mapInArrow(
        run, "lang string, k int, " + ", ".join(f"{c} long" for c in [*names, "n"]))


def gram_counts(texts: DataFrame, rules: PhraseRules, room: Scratch) -> tuple[DataFrame, DataFrame]:
    """(counts, words): (lang, k, w1 .., n) of all runs found ``least`` times, and (code, word) of their words."""
    spark = texts.sparkSession
    words = room.kept(vocabulary(texts))
    best = words.orderBy(F.desc("n"), "h").limit(rules.coded).select("h").collect()     # at most ``coded`` numbers
    h = np.array([r["h"] for r in best], dtype=np.int64).view(U)
    by = np.argsort(h)
    known, codes = h[by], by + 1
    few = spark.createDataFrame([(r["h"], i + 1) for i, r in enumerate(best)], "h long, small long")
    named = room.kept(words.filter(F.col("n") >= rules.least).join(few, "h", "left").select(
        F.coalesce("small", code_of(F.col("h"))).alias("code"), "word"))
    room.drop(words)
    for key, value in {"maxRecordsPerBatch": "65536", "maxBytesPerBatch": str(16 << 20)}.items():
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    try:
        parts = room.kept(_flows(_grams(texts, known, codes, rules), rules))
    finally:
        prepare(spark)
    counts = parts.groupBy("lang", "k", *rules.names).agg(F.sum("n").alias("n"))
    counts = room.kept(counts.filter((F.col("n") >= rules.least) | (F.col("k") == 0)))
    room.drop(parts)
    return counts, named


def compacted(counts: DataFrame, rules: PhraseRules, room: Scratch, rounds: int = 40) -> DataFrame:
    """(lang, words, n): the frequent edges, joined where one edge alone enters and leaves a node.

    A node whose count is that of one edge into it and of one edge out of it has no other edges, and no piece begins or ends
    there. Pointers to the edge before are doubled until all reach the head of their path. A path never
    leaves a piece of text, so no path is longer than the longest piece.
    """
    names = rules.names
    edges = room.kept(counts.filter(F.col("k") == rules.longest).withColumn("id", F.monotonically_increasing_id()))
    node = [f"v{i}" for i in range(1, rules.longest)]
    nodes = counts.filter(F.col("k") == rules.longest - 1).select(
        "lang", *[F.col(w).alias(v) for w, v in zip(names, node)], "n")
    into = edges.select("lang", *[F.col(w).alias(v) for w, v in zip(names[1:], node)], "n", F.col("id").alias("before"))
    out = edges.select("lang", *[F.col(w).alias(v) for w, v in zip(names, node)], "n", "id")
    on = ["lang", *node, "n"]
    link = out.join(into, on).join(nodes, on, "left_semi").select("id", "before")
    at = room.kept(edges.select("id").join(link, "id", "left").select(
        "id", F.coalesce("before", "id").alias("head"), F.col("before").isNotNull().cast("long").alias("steps")))
    total = at.agg(F.sum("steps")).first()[0]
    for _ in range(rounds):
        if not total:
            break
        next_ = at.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        on_, at = at, room.kept(at.join(next_, "head").select("id", F.col("_head").alias("head"),
                                                              (F.col("steps") + F.col("_steps")).alias("steps")))
        room.drop(on_)
        before, total = total, at.agg(F.sum("steps")).first()[0]
        if total == before:
            break
    else:
        if total:
            raise RuntimeError("paths did not settle")
    tails = at.join(edges.select("id", F.col(names[-1]).alias("word")), "id").groupBy("head").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("steps", "word"))), lambda s: s["word"]).alias("tail"))
    return room.kept(edges.join(tails, edges["id"] == tails["head"]).select(
        "lang", F.concat(F.array(*names[:-1]), "tail").alias("words"), "n"))


def _inside(counts: DataFrame, paths: DataFrame, rules: PhraseRules) -> DataFrame:
    """(lang, k, w1 .., longer): the largest count of a longer frequent phrase around a phrase."""
    names, found = rules.names, []

    def windows(words: DataFrame, k: int) -> DataFrame:
        return words.select("lang", "n", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.slice("words", i, k))).alias("part")).select(
            "lang", F.lit(k).alias("k"), *[F.get("part", F.lit(i)).alias(w) if i < k else F.lit(0).cast("long").alias(w)
                                           for i, w in enumerate(names)], "n")

    for k in range(2, rules.longest):
        found.append(windows(paths, k))
        for longer in range(k + 1, rules.longest):
            found.append(windows(counts.filter(F.col("k") == longer).select(
                "lang", "n", F.array(*names[:longer]).alias("words")), k))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "k", *names).agg(F.max("n").alias("longer"))


def scored(counts: DataFrame, rules: PhraseRules) -> DataFrame:
    """(lang, k, w1 .., a, l, r, score): every phrase with its lowest-scoring cut, the first of equal ones.

    floor(scale * a / (l + r)) in decimals of 38 digits: counts up to 20 digits are exact.
    """
    names = rules.names
    phrases = counts.filter("k >= 2").withColumnRenamed("n", "a")
    zero = F.lit(0).cast("long")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    split = phrases.select("*", cut)
    split = split.select(
        "*", *[F.when(F.col("cut") > i, F.col(w)).otherwise(zero).alias(f"l{i}") for i, w in enumerate(names)],
        *[F.when(F.col("cut") + i < F.col("k"), F.get(F.array(*names), F.col("cut") + i)).otherwise(zero).alias(f"r{i}")
          for i in range(rules.longest)])

    def parts(side: str) -> DataFrame:
        return counts.filter((F.col("k") >= 1) & (F.col("k") < rules.longest)).select(
            "lang", *[F.col(w).alias(f"{side}{i}") for i, w in enumerate(names)], F.col("n").alias(side))

    for side in ("l", "r"):
        split = split.join(parts(side), ["lang", *[f"{side}{i}" for i in range(rules.longest)]])
    score = F.expr(f"(cast(a as decimal(20, 0)) * {rules.scale}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return split.groupBy("lang", "k", *names, "a").agg(F.min(F.struct(
        score.alias("score"), "cut", "l", "r")).alias("best")).select(
        "lang", "k", *names, "a", "best.l", "best.r", "best.score")


def mine_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                 rules: PhraseRules = PhraseRules()) -> tuple[DataFrame, DataFrame]:
    """(phrases, paths): (lang, rank, phrase, a, l, r, n, score), and (lang, words, n) of the compacted graph.

    A-Z count as a-z. Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs; phrases
    never leave a piece. NULL and empty texts have no words; rows without a language belong to ``und``. Repeated rows
    count as often as they are there. Ties in score go by count, then by the phrase bytewise. An empty table,
    and one where nothing is found ``least`` times, gives no rows. Further columns of ``docs`` do not matter.
    Words beyond the most frequent ones are told apart by 63 bits of hash. Words in paths are codes.
    """
    spark = tidy(prepare(docs.sparkSession))
    room, names = Scratch(spark, "phrases"), rules.names
    inner, _, (body, tongue) = shield(docs, (), text, lang)
    texts = inner.select(F.coalesce(F.col(tongue).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(body), F.lit("")).alias("text"))
    counts, words = gram_counts(texts, rules, room)
    paths = compacted(counts, rules, room)
    key = ["lang", "k", *names]
    left = scored(counts, rules).join(_inside(counts, paths, rules), key, "left").filter(
        f"longer is null or 100 * cast(longer as decimal(20, 0)) < {rules.inside} * cast(a as decimal(20, 0))")
    # the group limit keeps each task's best only, up to as many as asked for
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(limit, str(max(rules.top, int(spark.conf.get(limit)))))
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = room.kept(left.drop("longer").withColumn("_at", F.rank().over(ahead)).filter(
        F.col("_at") <= rules.top).drop("_at"))
    spelt = best.select(*key, F.posexplode(F.array(*names)).alias("_at", "code")).filter("_at < k").join(
        words, "code").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("_at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    totals = counts.filter("k = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = best.join(spelt, key).join(totals, "lang").withColumn("rank", F.row_number().over(order).cast("long"))
    return found.filter(F.col("rank") <= rules.top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"), paths
