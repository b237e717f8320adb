"""Packing, search and piece encoding against brute force."""

import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm_data import documents, empty, odd, odd_rows
from visitloom.llm import block_max_search as bs, conflict_packing as cp, stream_pieces as sp
from visitloom.llm.queries import PIECES, QUERIES


def naive_pack(items, capacity):
    """(bin, offset) by looking at all bins for each item."""
    bins, out = [], []
    for length, source, cluster in items:
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if b["used"] + length <= capacity
                and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
            i = len(bins) - 1
        out.append((i, bins[i]["used"]))
        bins[i]["used"] += length
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
    return out


def test_pack_is_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(0, 120)
        items = [(rng.randint(1, 50), rng.choice("aaabcdef"), rng.randrange(40)) for _ in range(n)]
        items.sort(key=lambda x: -x[0])
        assert cp.pack(*([list(c) for c in zip(*items)] or [[], [], []]), 50) == naive_pack(items, 50)


def check_packed(rows, capacity):
    used = {}
    for r in rows:
        if r.bin is None:
            assert r.length == 0
            continue
        used.setdefault(r.bin, []).append((r.offset, r.offset + r.length))
    for spans in used.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] <= capacity


def test_pack_odd_rows(spark):
    rules = cp.PackRules(capacity=100, shard_items=8)
    rows = cp.pack_texts(odd(spark, bin=1, offset="x", piece=2), rules=rules).collect()
    check_packed(rows, 100)
    total = sum(len((r[1] or "").split()) for r in odd_rows())
    assert sum(r.length for r in rows) == total
    assert sum(r.bin is None for r in rows) == sum(not (r[1] or "").split() for r in odd_rows())
    assert cp.pack_texts(empty(spark), rules=rules).count() == 0


def test_pack_documents_keeps_conflicts_apart(spark):
    docs = documents(spark)
    packed = cp.pack_texts(docs)
    check_packed(packed.collect(), 2048)
    both = packed.join(docs.select("doc_id", "source", F.xxhash64(F.lower("text")).alias("c")), "doc_id")
    assert both.groupBy("bin", "source").count().filter("count > 1").isEmpty()
    assert both.groupBy("bin", "c").count().filter("count > 1").isEmpty()
    assert both.select("doc_id").distinct().count() == docs.count()


def naive_search(rows, rules):
    tokens = {}
    for n, (i, t) in enumerate(rows):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        tokens[n] = re.findall(r"[^\x20\x09-\x0D]+", low)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    mean = sum(map(len, tokens.values())) / max(1, len(rows))
    idf = {w: math.log(1 + (len(rows) - d + 0.5) / (d + 0.5)) for w, d in df.items()}

    def score(terms, n):
        t, out = tokens[n], 0.0
        for w in terms:
            tf = t.count(w)
            if tf:
                out += idf[w] * tf * (rules.k1 + 1) / (tf + rules.k1 * (1 - rules.b + rules.b * len(t) / mean))
        return out
    return tokens, idf, score


@pytest.mark.parametrize("words", [2_000_000, 300])
def test_search_documents(spark, words):
    """Scores equal those by brute force, for the query terms that the operator chose."""
    terms, checked = 4, 0
    docs, rules = documents(spark).limit(120).cache(), bs.SearchRules(k=5, terms=terms, shard_words=words, block=4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for r in bs.search(docs, F.col("doc_id") % 10 == 0, rules=rules).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc_id"], r["score"]))
    tokens, idf, score = naive_search(rows, rules)
    for n, (i, t) in enumerate(rows):
        if i % 10:
            continue
        part = {w: idf[w] * tf * (rules.k1 + 1) / (tf + rules.k1) for w in set(tokens[n])
                for tf in [tokens[n].count(w)]}
        ranked = sorted(part, key=lambda w: -part[w])
        if len(ranked) > terms and abs(part[ranked[terms]] - part[ranked[terms - 1]]) < 1e-9:
            continue                                     # a tie of terms goes by hash
        checked += 1
        want = sorted(((score(ranked[:terms], m), -j) for m, (j, _) in enumerate(rows)), reverse=True)
        want = [(s, -j) for s, j in want if s > 0][:5]
        have = [(s, j) for _, j, s in sorted(got[i])]
        assert [round(s, 9) for s, _ in have] == [round(s, 9) for s, _ in want]
    assert checked or words == 300


@pytest.mark.parametrize("words", [2_000_000, 300])
def test_search_all_terms(spark, words):
    """With as many terms as the longest text has, the answer is that of scoring every text for all words."""
    docs = documents(spark).filter("n_chars < 900").limit(40).cache()
    rules = bs.SearchRules(k=6, terms=10_000, shard_words=words, block=4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for r in bs.search(docs, F.col("doc_id") % 3 == 0, rules=rules).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc_id"], r["score"]))
    tokens, _, score = naive_search(rows, rules)
    for n, (i, _) in enumerate(rows):
        if i % 3 == 0 and tokens[n]:
            want = sorted(((score(sorted(set(tokens[n])), m), -j) for m, (j, _) in enumerate(rows)), reverse=True)
            have = sorted(got[i])
            assert [round(s, 8) for _, _, s in have] == [round(s, 8) for s, _ in want if s > 0][:6]


def test_search_query_scores_every_word(spark):
    """The registered query against scoring every row for all distinct words of the query text."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, Counter(re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(
        {c: c + 32 for c in range(65, 91)})))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rules, df, holds = bs.SearchRules(), Counter(w for _, t in rows for w in t), {}
    mean = sum(t.total() for _, t in rows) / len(rows)
    for n, (_, t) in enumerate(rows):
        norm = rules.k1 * (1 - rules.b + rules.b * t.total() / mean)
        for w, tf in t.items():
            idf = math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
            holds.setdefault(w, []).append((n, idf * tf * (rules.k1 + 1) / (tf + norm)))
    got = {}
    for r in QUERIES["op7_block_max_search"](spark, sf).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc_id"], r["score"]))
    asked = [(i, t) for i, t in rows if i % 100 == 0 and t]
    assert set(got) == {i for i, _ in asked} and any(len(t) > 24 for _, t in asked)
    for i, t in asked:
        total = Counter()
        for w in t:
            for n, part in holds[w]:
                total[n] += part
        want = sorted(((round(s, 8), -rows[n][0]) for n, s in total.items()), reverse=True)[:rules.k]
        assert [(round(s, 8), -j) for _, j, s in sorted(got[i])] == want


def test_search_blocks_of_terms(spark):
    docs = documents(spark).cache()
    whole, parts = ([sorted(map(tuple, bs.search(docs, F.col("doc_id") % 20 == 0, rules=r).collect()))]
                    for r in (bs.SearchRules(), bs.SearchRules(term_block=700, shard_words=4000, block=8)))
    assert [r[:3] for r in whole[0]] == [r[:3] for r in parts[0]]


def test_block_max_wand():
    rng = random.Random(3)
    for _ in range(300):
        n, k, block = rng.choice([5, 50, 300]), rng.choice([1, 3, 10]), rng.choice([1, 4, 64])
        ids, lists, sums = rng.sample(range(10 * n), n), [], {}
        for _ in range(rng.randint(1, 8)):
            docs = sorted(rng.sample(range(n), rng.randint(1, n)))
            parts = [rng.choice([0.5, 1.0, rng.random()]) for _ in docs]
            weight = rng.choice([1.0, 2.0, rng.random()])
            lists.append((weight, docs, parts, [max(parts[i:i + block]) for i in range(0, len(parts), block)]))
            for d, p in zip(docs, parts):
                sums[d] = sums.get(d, 0.0) + weight * p
        assert bs.best(lists, ids, k, block) == sorted(((s, -ids[d]) for d, s in sums.items()), reverse=True)[:k]


def test_best_rows_of_lists_in_one_buffer():
    """Lists that lie anywhere in shared buffers, as in a shard, give what copies of them give."""
    rng, rows = random.Random(12), 200
    docs = [sorted(rng.sample(range(rows), rng.choice([1, 3, 9, 60, 150]))) for _ in range(30)]
    parts = [[rng.random() for _ in d] for d in docs]
    tops = [[max(p[i:i + 4]) for i in range(0, len(p), 4)] for p in parts]
    end, stop = np.cumsum([len(d) for d in docs]), np.cumsum([len(t) for t in tops])
    flat = [np.concatenate(x) for x in (docs, parts, tops)]
    for _ in range(60):
        some = np.array(sorted(rng.sample(range(30), rng.randint(1, 12))))
        idf = np.array([rng.choice([0.01, 1.0, 5.0]) for _ in some])
        got = bs.best_rows(idf, end[some] - [len(docs[t]) for t in some], end[some], stop[some] - [len(tops[t]) for t in some],
                           *flat, list(range(rows)), 5, 4)
        assert got == bs.best([(w, docs[t], parts[t], tops[t]) for w, t in zip(idf, some)], list(range(rows)), 5, 4)


def test_shard_of_many_queries():
    """All queries of a shard at once: the best rows are those of adding everything up, and few rows are scored alone."""
    rng, rows, lists, k = np.random.default_rng(8), 900, 1500, 5
    share = 0.6 / (1 + np.arange(lists) / 8)                      # few long lists, many short ones
    has = (rng.random((rows, lists)) < share) & rng.permuted(np.tile(np.arange(lists) % 2, (rows, 1)), axis=0).astype(bool)
    has[500:503], has[0] = has[499], True
    parts = np.where(has, rng.uniform(0.5, 2, has.shape), 0.0)
    parts[500:503] = parts[499]
    idf = np.log(1 + (rows - has.sum(0) + 0.5) / (has.sum(0) + 0.5))
    at, docs = np.nonzero(has.T)
    shard = bs.Shard(idf, np.searchsorted(at, np.arange(lists + 1)), docs.astype(np.int32), parts.T[has.T], rows, 64)
    asked = [np.flatnonzero(has[q]) for q in range(1, rows, 3)] + [np.flatnonzero(has[500])]
    edges, flat = np.concatenate(([0], np.cumsum([len(a) for a in asked]))), np.concatenate(asked)
    ids, scored, shard.CELLS = list(range(rows, 0, -1)), [], 50 * rows
    want = [sorted(((sum((idf[t] * parts[:, t] for t in a), np.zeros(rows))[d], -ids[d]) for d in range(rows)), reverse=True)[:k]
            for a in asked]
    for floors in (np.full(len(asked), -math.inf), np.array([w[-1][0] for w in want]), np.array([w[0][0] for w in want])):
        got = {}
        for q, live in shard.candidates(edges, flat, k, floors):
            got[q] = shard.best(asked[q], live, ids, k, floors[q])
            scored.append(len(live))
        assert [got.get(q, []) for q in range(len(asked))] == [[x for x in w if x[0] >= f] for w, f in zip(want, floors)]
    assert 0 < len(shard.long) < lists and sum(scored) < 3 * len(asked) * 2 * k


def test_shard_holds_k_of_equal_rows(spark):
    """Of rows of equal words a shard holds those k that can be among the best; counts are of all rows."""
    rows = [(i, "b a A" if i % 5 else "a a b" if i % 10 else f"a c{i}") for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = bs.build_index(docs, 3.0, bs.SearchRules(k=3), "doc_id", "text").collect()
    held = [i for r in index for i in np.frombuffer(r["ids"], dtype=np.int64).tolist()]
    assert [i for i in held if i % 10] == [1, 2, 3] and len(held) == 3 + 39
    got = bs.search(docs, F.col("doc_id") == 399, rules=bs.SearchRules(k=3)).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]
    tokens, _, score = naive_search(rows, bs.SearchRules())
    assert {round(r["score"], 9) for r in got} == {round(score(set(tokens[0]), 0), 9)}


def test_shard_ties_are_added_up():
    """Hundreds of rows of one score, told apart by other words: each is scored exactly, the smaller key wins."""
    rows, idf = 600, np.array([0.7, 0.3] + [6.1] * 600)
    docs = np.concatenate((np.arange(rows), np.arange(0, rows, 2), np.arange(rows))).astype(np.int32)
    starts = np.concatenate(([0, rows], rows + rows // 2 + np.arange(rows + 1)))
    shard = bs.Shard(idf, starts, docs, np.full(len(docs), 0.9), rows, 64)
    asked, ids = np.array([0, 1, 9]), list(range(rows))
    (_, live), = shard.candidates(np.array([0, 3]), asked, 4, np.array([-math.inf]))
    high = 0.7 * 0.9 + 0.3 * 0.9
    assert len(live) == 301 and shard.best(asked, live, ids, 4, -math.inf) == [
        (0.7 * 0.9 + 6.1 * 0.9, -7), (high, 0), (high, -2), (high, -4)]
    assert shard.scores(asked, live[:3]) == shard.scores(asked, live)[:3]


def test_search_starts_from_floors(spark, monkeypatch):
    """One shard in eight is searched first; the others then send no row below the k-th score found there."""
    docs, rules, seen, real = documents(spark).cache(), bs.SearchRules(k=3, shard_words=2000), [], bs._searched

    def searched(index, held, least, rules):
        out = real(index, held, least, rules)
        seen.append((index.count(), dict(zip(held.value[0].tolist(), least.value.tolist())), out.collect()))
        return out

    monkeypatch.setattr(bs, "_searched", searched)
    got = bs.search(docs, F.col("doc_id") % 10 == 0, rules=rules).collect()
    (few, none, first), (many, floors, more) = seen
    last = {r["query"]: r["score"] for r in got if r["rank"] == 3}
    assert 0 < few < many / 4 and set(none.values()) == {-math.inf}
    assert any(f > -math.inf for f in floors.values()) and all(floors[q] <= x for q, x in last.items())
    assert all(r["score"] >= floors[r["query"]] for r in more)
    assert {(r["query"], r["doc_id"], r["score"]) for r in got} <= {tuple(r) for r in first + more}


def test_search_odd_rows(spark):
    got = bs.search(odd(spark, query=1, score="x", rank=2), F.lit(True), rules=bs.SearchRules(query_block=3)).collect()
    texts = {}
    for r in odd_rows():
        if r[0] is not None and (r[1] or "").split():
            texts[r[0]] = r[1]
    assert {r["query"] for r in got} == set(texts) and {r["doc_id"] for r in got} <= set(texts)
    first = {r["query"]: r["doc_id"] for r in got if r["rank"] == 1}
    assert first[4] == 3 and first[3] == 3 and first[9] == 8      # ties go to the smaller key
    assert bs.search(empty(spark), F.lit(True)).count() == 0


def best_path_sum(pieces, text):
    """Largest sum of scores over all segmentations, by the whole lattice."""
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.longest), j):
            s = pieces.scores.get(text[i:j], pieces.worst if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@pytest.fixture(scope="module")
def pieces():
    return sp.read_pieces(PIECES)


def texts(n, rng):
    parts = ["a", "the", "x", " ", "  ", "ß", "日本", "ing", "\n", "tion", "🙂", "er", "http", "0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_path_is_best_and_streaming_changes_nothing(pieces):
    rng = random.Random(6)
    for text in texts(80, rng):
        spans = list(pieces.path(text))
        assert "".join(text[a:b] for a, b in spans) == text
        total = sum(pieces.scores.get(text[a:b], pieces.worst) for a, b in spans)
        assert total == best_path_sum(pieces, text)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))     # no word start to commit at
    spans = list(pieces.path(long))
    assert sum(pieces.scores.get(long[a:b], pieces.worst) for a, b in spans) == best_path_sum(pieces, long)


def test_pieces_round_trip_and_library_decoding(pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts(200, random.Random(7)):
        ids = pieces.encode(text).tolist()
        assert pieces.decode(ids) == text
        assert library.decode(ids) == text or text.startswith(" ") or not text


def test_pieces_with_one_word_at_a_time_equal_the_whole(pieces):
    whole = sp.read_pieces(PIECES)
    whole.joined = True
    for text in texts(60, random.Random(8)):
        assert pieces.encode(text).tolist() == whole.encode(text).tolist()


def test_pieces_of_new_words_are_searched_side_by_side(pieces, monkeypatch):
    calls = [0]
    text = " ".join(f"{i:x}w{i * 7919 % 10007}" for i in range(4000))
    pieces.encode("warm")
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        ids = pieces.encode(text).tolist()
    finally:
        sys.setprofile(None)
    assert calls[0] < 1000 and pieces.decode(ids) == text        # one search for each word would be 4,000
    odd = [*texts(150, random.Random(9)), "", " ", "  a", "a  ", "▁ ▁x", "\0\0 \0", "🙂" * 70 + " b", "한é\U0010ffff the"]
    for at_once, step, remember in ((100_000, 8192, 500_000), (7, 3, 10)):
        for name, size in (("AT_ONCE", at_once), ("STEP", step), ("REMEMBER", remember)):
            monkeypatch.setattr(sp, name, size)
        fresh = sp.read_pieces(PIECES)
        for t, ids in zip(odd, fresh.encode_all(odd), strict=True):
            parts = re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁")) if t else []
            assert ids.tolist() == [i for part in parts for i in fresh.ids_of(part)]


def test_pieces_odd_rows(spark):
    df = odd(spark, ids="x", decoded=1)
    back = sp.decode_ids(sp.encode_texts(df, PIECES), PIECES)
    assert back.filter(~F.col("decoded").eqNullSafe(F.col("text"))).isEmpty()
    rows = back.collect()
    assert len(rows) == len(odd_rows())
    assert all((r.ids is None) == (r.text is None) and (r.text != "" or r.ids == []) for r in rows)
    assert sp.encode_texts(empty(spark), PIECES).count() == 0
    assert np.iinfo(np.int32).max > 32_000
