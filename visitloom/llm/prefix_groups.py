"""N-gram Jaccard join by grouped prefixes.

A text is the set of its distinct word shingles, in one global order (frequent shingles last, then by
hash). Two sets of Jaccard similarity t or more share one of their first n - ceil(t n) + 1 shingles, the
prefix. Texts with equal prefixes and sizes form a group and act as one in the candidate search; groups
that meet in a shingle are expanded to their members, and members are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BASE, mix, powers, word_chunks
from .shared import connected, kept

U = np.uint64
NONE = (1 << 63) - 1     # stands for a NULL id in comparisons
ROUNDS = 5               # of pivots at most; each is linear in the members of the buckets
SKETCH = [f"b{i}" for i in range(8)]


@dataclass(frozen=True)
class JoinRules:
    """Link when 100 * intersection >= percent * union. The other numbers change the work, not the answer:
    the order puts at most ``frequent`` shingles last, and every member of a bucket is compared with ``pivots`` of it,
    in up to ``ROUNDS`` rounds, before all pairs that are then still apart."""
    width: int = 5
    percent: int = 80
    frequent: int = 1 << 17
    least_frequency: int = 64
    pivots: int = 2


def shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row, as 64-bit values."""
    scale = powers(int(mix(np.array([BASE]))[0]) | 1, width + 1)
    for _, counts, words in word_chunks(column):
        n = len(words)
        grams = np.zeros(0, dtype=U)
        if n >= width:
            grams = words[:n - width + 1] * scale[1]
            for k in range(1, width):
                grams = grams + words[k:n - width + 1 + k] * scale[k + 1]
            grams = mix(grams)
        at = 0
        for c in counts:
            if c >= width:
                yield np.unique(grams[at:at + c - width + 1])
            elif c:
                whole = (words[at:at + c] * scale[1:c + 1]).sum(dtype=U) + U(c)
                yield mix(np.array([whole], dtype=U) ^ BASE)
            else:
                yield np.zeros(0, dtype=U)
            at += c


def signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = mix(values ^ U(0x51ED27))
    return (int(a.sum(dtype=U).view(np.int64)), int(mix(a + BASE).sum(dtype=U).view(np.int64)))


def sketch(values: np.ndarray) -> list[int]:
    """512 bits: whether an odd number of the set's members falls on each. Two sets differ in at least as many members
    as their sketches in bits."""
    hits = np.bincount((mix(values ^ U(0xB175)) >> U(55)).astype(np.int64), minlength=512)
    return np.packbits((hits & 1).astype(np.uint8)).view(np.int64).tolist()


def frequent_shingles(docs: DataFrame, text: str, rules: JoinRules) -> np.ndarray:
    """The shingles that most texts have, most frequent first; at most ``rules.frequent`` of them.

    Each task counts runs of two million shingles and sends on those it saw four times or more.
    """
    width = rules.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            values, hits = np.unique(np.concatenate(held), return_counts=True)
            many = hits >= 4
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(hits[many])],
                                              names=["shingle", "hits"])
        for batch in batches:
            for s in shingles(batch.column(0), width):
                held.append(s)
                size += len(s)
            if size > 1 << 21:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    found = docs.select(text).mapInArrow(count, "shingle long, hits long").groupBy("shingle").agg(
        F.sum("hits").alias("hits")).filter(F.col("hits") >= rules.least_frequency)
    rows = found.orderBy(F.desc("hits"), "shingle").limit(rules.frequent).select("shingle").toPandas()
    return rows["shingle"].to_numpy(dtype=np.int64).view(U)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _sets(docs: DataFrame, key: str, text: str, rules: JoinRules) -> DataFrame:
    """(id, n, s1, s2, p1, p2, b0 .. b7, prefix): size, signature of the set and of the prefix, sketch, prefix shingles."""
    frequent = frequent_shingles(docs, text, rules)
    order = np.argsort(frequent)
    held = docs.sparkSession.sparkContext.broadcast((frequent[order], order))
    width, percent = rules.width, rules.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = held.value
        total = len(known)
        for batch in batches:
            out = []
            for s in shingles(batch.column(1), width):
                n = len(s)
                if total and n:
                    at = np.minimum(np.searchsorted(known, s), total - 1)
                    often = known[at] == s
                    late = s[often][np.argsort(-place[at[often]], kind="stable")]   # the most frequent very last
                    s_in_order = np.concatenate([s[~often], late])
                else:
                    s_in_order = s
                prefix = s_in_order[:prefix_length(n, percent)] if n else s
                out.append((n, *signature(s), *signature(prefix), *sketch(s), prefix.view(np.int64)))
            cols = list(zip(*out)) if out else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:-1]],
                 pa.array(list(cols[-1]), pa.list_(pa.int64()))], names=names)

    names = ["id", "n", "s1", "s2", "p1", "p2", *SKETCH, "prefix"]
    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(
        run, ", ".join([*(f"{c} long" for c in names[:-1]), "prefix array<long>"]))


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, classes: DataFrame, rules: JoinRules) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets are similar enough; only the sets of these classes are made."""
    pairs = kept(pairs, "pairs")
    wanted = classes.join(pairs.select("a").union(pairs.select("b")).distinct(), classes["cid"] == F.col("a"),
                          "left_semi").select("cid", "least", "s1")
    sets = kept(_whole_sets(docs, key, text, wanted, rules.width), "shingles")
    wide = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    percent = rules.percent

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))

    return wide.mapInArrow(check, "a long, b long")


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 rules: JoinRules = JoinRules()) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, n_texts.

    ``key`` is an integer column. Words are runs of bytes without white space, A-Z folded. A text of fewer
    words than ``width`` has its whole sequence as its one shingle; one without words, or NULL, has none, is
    linked with nothing and is its own component. component_id is the smallest key that links reach, NULL
    only where all keys of the component are NULL. n_texts counts the different sets of the component
    (0 without words). Rows with equal sets are one class whatever their number, so copies cost one row per
    task after the first scan; equal keys on different texts stay apart. An empty table gives no rows; other
    columns are ignored. Only flags, and at most ``frequent`` shingles, reach the driver.
    """
    rows = kept(_sets(docs, key, text, rules), "sets")
    full = rows.filter("n > 0")
    # a group's number is a hash: should two groups share one, they only meet as members of one bucket more
    gid = F.xxhash64("p1", "p2", "n").alias("gid")
    groups = full.groupBy("p1", "p2", "n").agg(F.first("prefix").alias("prefix")).select(gid, "prefix")
    # the numbers of classes are given as the table is written, and stay as written
    classes = kept(full.groupBy("s1", "s2", "n", "p1", "p2").agg(
        F.coalesce(F.min("id"), F.lit(NONE)).alias("least"), *[F.first(b).alias(b) for b in SKETCH]).select(
        "s1", "s2", "n", "least", gid, F.monotonically_increasing_id().alias("cid"), *SKETCH), "classes")

    # buckets: the groups of a prefix shingle that two groups have, and each group of several classes by itself;
    # of a shingle, at: its place in the prefix, known: how many before it another group has too
    tokens = groups.select("gid", F.posexplode("prefix").alias("at", "bucket"))
    tokens = tokens.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("groups > 1")
    inside = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(
        "gid", F.lit(0).alias("at"), F.col("gid").alias("bucket"), F.lit(False).alias("met"))
    met = tokens.select("gid", "at", "bucket", F.lit(True).alias("met")).unionByName(inside)
    met = met.withColumn("known", F.row_number().over(Window.partitionBy("gid", "met").orderBy("at")) - 1)
    members = kept(met.join(classes.select("cid", "gid", "n"), "gid"), "members")

    sketches, prefixes = classes.select("cid", *SKETCH), classes.join(groups, "gid").select("cid", "gid", "n", "prefix")
    links = kept(_verified(_pivot_pairs(members, rules), docs, key, text, classes, rules), "links")
    found = kept(connected(links), "roots")
    total, before = members.count(), None
    for turn in range(1, ROUNDS + 1):
        open_ = _open(members, found, sketches)
        pairs = open_.groupBy("bucket", "met").agg((F.count(F.lit(1)) * 1.0).alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
        if not pairs:
            break
        # pivots again while the pairs are many and each round closes some
        many = turn < ROUNDS and pairs > total and (before is None or pairs < 0.9 * before)
        pairs, before = (_close_pivot_pairs(open_, rules, turn) if many else _open_pairs(open_, rules)), pairs
        more = kept(_verified(_enough_prefix(kept(pairs, "close"), prefixes, rules), docs, key, text, classes, rules), "links")
        stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = kept(connected(stars.union(more)), "roots")
        if not many:
            break
    roots = classes.select("cid").join(found, F.col("cid") == F.col("node"), "left").select(
        "cid", F.coalesce("root", "cid").alias("root"))

    joined = classes.join(roots, "cid")
    whole = joined.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n_texts"))
    joined = joined.drop("least").join(whole, "root").select(
        "s1", "s2", "n", F.when(F.col("least") < NONE, F.col("least")).alias("component_id"), "n_texts")
    out = rows.select("id", "n", "s1", "s2").join(joined, ["s1", "s2", "n"], "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def _whole_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, each from a text that has its smallest key."""
    least = F.coalesce(F.col(key).cast("long"), F.lit(NONE))
    held = docs.select(least.alias("least"), text).join(
        wanted.select("least").distinct().hint("shuffle_hash"), "least", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([signature(s)[0] for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["least", "s1", "shingles"])

    made = held.mapInArrow(run, "least long, s1 long, shingles binary")
    return made.join(wanted, ["least", "s1"]).select("cid", "shingles").dropDuplicates(["cid"])


def _near(met: Column, a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether two members of a bucket may be similar enough.

    A common shingle has at most min(known) common ones before it, as those of no other group are in no other
    prefix that reaches this far, and at most min(n - at - 1) after it.
    """
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    most = F.least(a["known"], b["known"]) + 1 + F.least(a["n"] - a["at"], b["n"] - b["at"]) - 1
    return (100 * small >= percent * large) & (~met | ((100 + percent) * most >= percent * (a["n"] + b["n"])))


def _close(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether two members of a bucket may be similar enough, should theirs be the first common shingle.

    Similar sets have ``need`` common members, all of them from the first common one on, and differ in no more than
    the rest; so the bucket of the first common shingle passes, which is enough to find the pair.
    """
    need = F.ceil(percent * (a["n"] + b["n"]) / (100 + percent))
    bits = sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in SKETCH), F.lit(0))
    return ((100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"]))
            & (a["n"] - a["at"] >= need) & (b["n"] - b["at"] >= need) & (bits <= a["n"] + b["n"] - 2 * need))


def _enough_prefix(pairs: DataFrame, prefixes: DataFrame, rules: JoinRules) -> DataFrame:
    """The pairs of classes that share enough prefix shingles, each once.

    Beyond its prefix a set has ceil(t n) - 1 shingles, so c shared prefix shingles allow an overlap
    of at most c + max(ceil(t n) - 1); members of one group share their whole prefix.
    """
    percent = rules.percent
    first, second = (prefixes.select(F.col("cid").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("gid", "n", "prefix")])
                     for i in "ab")
    rest = F.ceil(percent * F.greatest("n_a", "n_b") / 100) - 1
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return pairs.distinct().join(first, "a").join(second, "b").filter(
        (F.col("gid_a") == F.col("gid_b")) | (F.size(F.array_intersect("prefix_a", "prefix_b")) + rest >= need)).select("a", "b")


def _enough_shared(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows (a, b, n, n2, met) that met often enough to be similar.

    Beyond its prefix a set has ceil(t n) - 1 shingles, so c shared prefix shingles allow an overlap
    of at most c + max(ceil(t n) - 1); members of one group share their whole prefix and meet in its own bucket.
    """
    counted = pairs.groupBy("a", "b").agg(F.count_if("met").alias("shared"), F.count_if(~F.col("met")).alias("same_group"),
                                          F.max("n").alias("n"), F.max("n2").alias("n2"))
    rest = F.ceil(percent * F.greatest("n", "n2") / 100) - 1
    need = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))
    return counted.filter((F.col("same_group") > 0) | (F.col("shared") + rest >= need)).select("a", "b")


def _pivot_pairs(placed: DataFrame, rules: JoinRules) -> DataFrame:
    """Every member with the pivots of its bucket: those of least hash, for each of several hashes.

    A pair is counted only where one is the other's pivot, so some similar pairs are left to later rounds and ``_open_pairs``.
    """
    me = {c: F.col(c) for c in ("n", "at", "known")}
    pairs = []
    pivots = placed.groupBy("bucket", "met").agg(*[
        F.min(F.struct(F.xxhash64(F.lit(i), "cid").alias("h"), "cid", "n", "at", "known", "gid")).alias(f"v{i}")
        for i in range(rules.pivots)], F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    met = placed.join(pivots, ["bucket", "met"])
    for i in range(rules.pivots):
        v = {c: F.col(f"v{i}.{c}") for c in ("n", "at", "known", "cid", "gid")}
        ok = (F.col("cid") != v["cid"]) & (~F.col("met") | (F.col("gid") != v["gid"]))
        pairs.append(F.when(ok & _near(F.col("met"), me, v, rules.percent), F.struct(
            F.least("cid", v["cid"]).alias("a"), F.greatest("cid", v["cid"]).alias("b"),
            F.least("n", v["n"]).alias("n"), F.greatest("n", v["n"]).alias("n2"))))
    told = met.select("met", F.explode(F.array_distinct(F.array_compact(F.array(*pairs)))).alias("p"))
    return _enough_shared(told.select("p.*", "met"), rules.percent)


def _open(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with component and sketch."""
    placed = members.join(found, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    placed = placed.select("bucket", "met", "cid", "root", "n", "gid", "at")
    several = placed.groupBy("bucket", "met").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(
        "lo <> hi").select("bucket", "met")
    return kept(placed.join(several, ["bucket", "met"]), "open").join(sketches, "cid")


def _close_pivot_pairs(open_: DataFrame, rules: JoinRules, turn: int) -> DataFrame:
    """Every member with other pivots of its bucket, those in its own component left out."""
    columns = ("cid", "root", "n", "gid", "at", *SKETCH)
    pivots = open_.groupBy("bucket", "met").agg(*[
        F.min(F.struct(F.xxhash64(F.lit(rules.pivots * turn + i), "cid").alias("h"), *columns)).alias(f"v{i}")
        for i in range(rules.pivots)])
    both, me, pairs = open_.join(pivots, ["bucket", "met"]), {c: F.col(c) for c in columns}, []
    for i in range(rules.pivots):
        v = {c: F.col(f"v{i}.{c}") for c in columns}
        ok = (F.col("root") != v["root"]) & (~F.col("met") | (F.col("gid") != v["gid"])) & _close(me, v, rules.percent)
        pairs.append(F.when(ok, F.struct(F.least("cid", v["cid"]).alias("a"), F.greatest("cid", v["cid"]).alias("b"))))
    return both.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.*")


def _open_pairs(open_: DataFrame, rules: JoinRules) -> DataFrame:
    """All pairs of a bucket that are in different components and close enough."""
    columns = ("cid", "root", "n", "gid", "at", *SKETCH)
    right = open_.select("bucket", "met", *[F.col(c).alias(f"{c}_2") for c in columns])
    me, it = ({c: F.col(c + x) for c in columns} for x in ("", "_2"))
    return open_.join(right, ["bucket", "met"]).filter(
        (F.col("cid") < F.col("cid_2")) & (F.col("root") != F.col("root_2"))
        & (~F.col("met") | (F.col("gid") != F.col("gid_2"))) & _close(me, it, rules.percent)).select(
        F.col("cid").alias("a"), F.col("cid_2").alias("b"))
