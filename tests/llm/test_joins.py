"""The Jaccard join and the removal of repeated strings against brute force."""

import random

import numpy as np
import pytest

from llm_data import components, documents, empty, odd, odd_rows, repeated
from visitloom.llm import run_index as ri
from visitloom.llm.prefix_groups import JoinRules, jaccard_join
from visitloom.llm.shared import connected


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("rules", [JoinRules(), JoinRules(least_frequency=4, pivots=1)])
def test_join_odd_rows(spark, rules):
    got = [tuple(r)[:3] for r in jaccard_join(odd(spark, n_shingles=1, component_id="x"), rules=rules).collect()]
    want = components([(r[0], r[1]) for r in odd_rows()])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_join_documents(spark):
    docs = documents(spark)
    got = [tuple(r)[:3] for r in jaccard_join(docs).collect()]
    assert sorted(got) == sorted(components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]))


def test_join_chains_and_ties(spark):
    """A chain of texts, each like the next only, is one component; a similarity of exactly 0.8 links."""
    base = [f"a{i}" for i in range(200)]
    chain = [(i, " ".join(base[5 * i:5 * i + 100])) for i in range(12)]
    nine = [f"b{i}" for i in range(13)]                 # 9 shingles; the first 8 of them and one more: 8 / 10
    more = [(50, " ".join(nine)), (51, " ".join(nine[:12] + ["z"])), (52, " ".join(nine[3:]))]
    rows = chain + more
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"),
                       rules=JoinRules(pivots=3)).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(components(rows))
    assert {r.component_id for r in got if r.doc_id < 12} == {0}


def test_join_empty(spark):
    assert jaccard_join(empty(spark)).count() == 0


def test_connected(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def test_matching_statistics():
    rng = random.Random(2)
    for trial in range(120):
        length = rng.choice([2, 5, 12, 20])
        base = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdef") for _ in range(rng.randint(1, 60)))
                for _ in range(4)]
        texts = [b"".join(rng.choice(base) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 7))]
        strings = [t[i:i + length] for t in texts for i in range(len(t) - length + 1)]
        for text, mask in zip(texts, ri.repeated_places(texts, length)):
            want = [i + length <= len(text) and strings.count(text[i:i + length]) > 1 for i in range(len(text))]
            assert mask.tolist() == want


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_every_window_is_in_one_segment(monkeypatch, chunk):
    monkeypatch.setattr(ri, "CHUNK", chunk)
    rng, rules = random.Random(3), ri.IndexRules(length=20, anchor=5)
    for trial in range(30):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdef") for _ in range(rng.choice([0, 5, 19, 20, 21, 300])))
                 for _ in range(6)]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        got = [(o, s + k) for cols in ri.text_segments(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, rules)
               for o, s, n in zip(*cols[:3]) for k in range(n)]
        assert len(set(got)) == len(got)
        assert set(got) == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)}


@pytest.mark.parametrize("crowd", [64, 1])
def test_remove_repeats_odd_rows(spark, crowd):
    rules = ri.IndexRules(length=60, anchor=12, crowd=crowd)
    got = ri.remove_repeats(odd(spark, kept="x", spans=1, n_bytes="y"), rules=rules)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "n_removed", "spans", "kept"]
    rows = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    want = [(i, len((t or "").encode()), n, spans, kept) for (i, t, *_), (kept, n, spans)
            in zip(odd_rows(), repeated([r[1] for r in odd_rows()], 60))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(rows, key=order) == sorted(want, key=order)


def test_remove_repeats_documents(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, repeated(list(texts.values()), 200)))
    for r in ri.remove_repeats(docs).collect():
        assert (bytes(r.kept), r.n_removed, [tuple(s) for s in r.spans]) == want[r.doc_id]


def test_remove_repeats_empty(spark):
    assert ri.remove_repeats(empty(spark)).count() == 0


def rows_made(spark, since=0):
    """The most rows that a Python step of the queries from ``since`` on made, and the number of queries."""
    store = spark._jsparkSession.sharedState().statusStore()
    done, tasks = store.executionsList(), [0]
    for i in range(done.size()):
        number = done.apply(i).executionId()
        if number < since:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    if "MapInArrow" in node.name():
                        tasks.append(int(value.get().replace(",", "")))
    return max(tasks), max((done.apply(i).executionId() for i in range(done.size())), default=-1) + 1


def test_join_of_texts_that_share_much(spark):
    """Copies with many changes share shingles without being alike; rounds of pivots and sketches lose no link."""
    rng, base, rows = random.Random(8), [f"w{i}" for i in range(150)], []
    for i in range(260):
        text = list(base)
        for j in rng.sample(range(150), rng.choice([1, 2, 5, 6, 7])):
            text[j] = f"x{i}_{j}"
        rows.append((i, " ".join(text)))
    got = [tuple(r)[:3] for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(components(rows))


def test_windows_of_crowded_anchors_are_counted_in_ranges(spark):
    """A passage between different words in many texts: its windows are not made one by one."""
    rng = random.Random(9)
    same = "".join(rng.choice("abcdefgh") for _ in range(260))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(300)) + same[rng.randrange(40):][:rng.randrange(205, 220)]
             + "".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(150)]
    since = rows_made(spark)[1]
    got = {r.doc_id: (bytes(r.kept), r.n_removed, [tuple(s) for s in r.spans]) for r in ri.remove_repeats(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(repeated(texts, 200)))
    segments = sum(len(c[0]) for c in ri.text_segments(np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum(
        [0] + [len(t) for t in texts]), ri.IndexRules()))
    assert rows_made(spark, since)[0] <= 2 * segments
