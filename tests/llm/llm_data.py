"""Small tables with every odd case, and brute-force versions."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """NULLs in every column, empty and very long texts, repeated rows, ties, copies."""
    rng = random.Random(5)
    same = words(rng, 120)
    near = same.split()
    near[60] = "changed"
    long_text = words(rng, 60_000, 5000)
    return [
        (None, None, None, None, None), (None, same, "en", "s0", 1), (1, "", "en", "s0", 0), (1, "", "en", "s0", 0),
        (2, None, "en", None, None), (3, same, "en", "s0", 5), (4, same, None, "s0", 5), (4, same, None, "s0", 5),
        (5, " ".join(near), "en", "s1", 5), (6, long_text, "de", "s0", 9), (7, " \t\n", "de", "s2", 3),
        (8, "one two", "fr", "s2", 7), (9, "ONE two", "fr", "s2", 7), (10, "ünï çödé ☃ 🙂 " * 40, "fr", "s1", 1),
        (12, words(rng, 90), "en", "s1", 1), (13, "x" * 5000, None, "s1", 1)]


def odd(spark, **clash):
    """The odd rows, with extra columns whose names clash with those that an operator adds."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sets_of(text, width=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def components(rows):
    """component_id by brute force for (id, text) rows with ids."""
    sets = [(i, sets_of(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)]


def repeated(texts, length):
    """(bytes kept, removed, spans) of every text by counting all strings of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((bytes(x for x, g in zip(d, gone) if not g), sum(gone), spans))
    return out
