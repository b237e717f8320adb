"""Copied word windows, phrases and Merkle trees against brute force and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_data import SCHEMA, documents, empty, odd, odd_rows, words
from visitloom.llm.merkle_manifest import TreeRules, folded, manifest, siblings
from visitloom.llm.phrase_graph import PhraseRules, mine_phrases
from visitloom.llm.window_repeats import WindowRules, remove_copied_windows

CLASH = {"_row": 1, "N_Words": 2, "kept": "x", "a.dot": 3, "_list": 4, "seed": 5, "_SALT": 6, "tree": 7}


def cut_windows(rows, width):
    """(id, words, spans, kept) by brute force."""
    ids = defaultdict(list)
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for a in range(len(w) - width + 1):
                ids[tuple(w[a:a + width])].append(i)
    least = {k: min(v) for k, v in ids.items()}
    out = []
    for i, w in texts:
        gone = bytearray(len(w))
        for a in range(len(w) - width + 1):
            if i is not None and least[tuple(w[a:a + width])] < i:
                gone[a:a + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def told(df):
    rows = [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


@pytest.mark.parametrize("rules", [WindowRules(), WindowRules(4, 2), WindowRules(3, 3), WindowRules(1, 1)])
def test_windows_odd_rows(spark, rules):
    got = remove_copied_windows(odd(spark, **CLASH), rules=rules)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "a.dot", "_list", "seed", "_SALT",
                           "tree", "n_words", "n_removed", "spans", "kept"]
    assert told(got) == cut_windows([r[:2] for r in odd_rows()], rules.width)


def test_windows_few_words(spark):
    """Texts over three words: windows overlap, repeat inside a text and sit in many different runs."""
    rng = random.Random(7)
    rows = [(i % 23, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 5, 9, 40])))) for i in range(60)]
    rows = list({(i, t) for i, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rules in (WindowRules(5, 2), WindowRules(13, 5)):
        assert told(remove_copied_windows(df, rules=rules)) == cut_windows(rows, rules.width)


def test_windows_documents(spark):
    docs = documents(spark)
    assert told(remove_copied_windows(docs)) == cut_windows([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_windows_empty_and_rules(spark):
    assert remove_copied_windows(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        WindowRules(3, 4)


def phrases(rows, rules):
    """The phrases of every language by counting all runs of words."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, rules.longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= rules.least}
        around = Counter()
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i:i + k]] = max(around[g[i:i + k]], a)
        alive = []
        for g, a in often.items():
            score, cut = min((rules.scale * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            if 100 * around[g] < rules.inside * a:
                alive.append((-score, -a, " ".join(g).encode(), c[g[:cut]], c[g[cut:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, total[lang], -s)
                for i, (s, a, g, left, right) in enumerate(sorted(alive)[:rules.top])]
    return sorted(out)


@pytest.mark.parametrize("rules", [PhraseRules(least=2, coded=3, batch=50), PhraseRules(least=3, longest=5, top=7),
                                   PhraseRules(least=1, longest=3, inside=50)])
def test_phrases_by_counting(spark, rules):
    rng = random.Random(11)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["", " ", "\t"]) + "".join(
        rng.choice(["a", "B", "ünï", "Ab", "c"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "])
        for _ in range(rng.choice([0, 1, 4, 30])))) for _ in range(50)]
    rows += [("en", "one long path that many texts share word by word")] * 5 + [("und", None), ("fr", "")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumn("LANG2", F.lit(1))
    found, paths = mine_phrases(df, rules=rules)
    assert sorted(tuple(r) for r in found.collect()) == phrases(rows, rules)
    assert paths.filter(F.size("words") < rules.longest).count() == 0


def test_phrase_paths(spark):
    """A text that repeats is one path; where another text leaves it the path is cut."""
    base = [f"p{i}" for i in range(12)]
    rows = [(" ".join(base), "en")] * 3 + [(" ".join(base[:6] + ["x", "y", "z"]), "en")] * 2
    _, paths = mine_phrases(spark.createDataFrame(rows, "text string, lang string"), rules=PhraseRules(least=2))
    # edges p0..p3, .., p2..p5 have 5 texts; then one side has 3 and the other 2
    assert sorted((r.n, len(r.words)) for r in paths.collect()) == [(2, 6), (3, 9), (5, 6)]


def test_phrases_odd_and_empty(spark):
    rules = PhraseRules(least=2)
    found, _ = mine_phrases(odd(spark, words=1, n=2), rules=rules)
    got = {tuple(r) for r in found.collect()}
    assert got == set(phrases([(r[2], r[1]) for r in odd_rows()], rules))
    assert mine_phrases(empty(spark))[0].count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trees(rows, arity):
    """{(row): (leaf, subroot, root)} for (doc_id, text, lang, source, n_chars) rows."""
    def code(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
        return nodes[0]

    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = sha("".join(map(code, (i, source, lang, n, text))))
        groups[source].append(((i is not None, i or 0, leaf), i, leaf))
    tops = {g: climb([x[2] for x in sorted(v)]) for g, v in groups.items()}
    order = sorted(tops, key=lambda g: (g is not None, (g or "").encode()))
    root = climb([tops[g] for g in order])
    return sorted(((i is not None, i or 0), leaf, tops[g], root) for g, v in groups.items() for _, i, leaf in v)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_trees_odd_rows(spark, arity):
    out = manifest(odd(spark, **CLASH), rules=TreeRules(arity)).withColumn(
        "back", folded(F.col("leaf"), F.col("path"))).withColumn("near", siblings(F.col("path")))
    rows = out.collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.leaf, r.subroot, r.root) for r in rows) == trees(
        odd_rows(), arity)
    assert all(r.back == r.root and len(r.near) % 64 == 0 for r in rows)


def test_trees_many_sizes(spark):
    """Groups of 1 to 28 rows, more groups than an arity, one row changed afterwards."""
    rows = [(100 * g + i, f"t{i % 3}\n", None, f"s{g:02}" if g else None, i) for g in range(29) for i in range(g + 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = F.when(F.col("doc_id") == 300, F.lit("0")).otherwise(F.lit("same"))
    out = manifest(df, also={"mark": changed})
    got = out.withColumn("back", folded(F.when(F.col("mark") == "0", F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf")),
                                        F.col("path"))).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.leaf, r.subroot, r.root) for r in got) == trees(rows, 3)
    assert {r.doc_id for r in got if r.back != r.root} == {300}


def test_trees_empty(spark):
    assert manifest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        TreeRules(1)
