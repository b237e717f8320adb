"""The pipeline against brute force, stage by stage."""

import re

import corpus_pipeline as cpl
from llm_data import SF, components, documents, empty, odd, odd_rows, repeated
from test_packing_search_pieces import check_packed
from test_texts import counts
from visitloom.llm.blob_ledger import find_secrets
from visitloom.llm.queries import QUERIES


def test_stages_on_documents(spark):
    docs = documents(spark).select(*cpl.COLUMNS)
    start = {r.doc_id: r.text for r in docs.collect()}

    good = cpl.quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(not counts(t)[5] for t in kept.values()) and all(start[i] == t for i, t in kept.items())
    assert len(kept) > 0.7 * sum(not counts(t)[5] for t in start.values())

    good = spark.createDataFrame(good.collect(), good.schema)
    single = cpl.near_duplicates(spark, good, SF)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in components(list(kept.items()))}

    single = spark.createDataFrame(single.collect(), single.schema)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {i: k.decode("utf-8", "ignore") for (i, _), (k, _, _) in zip(rows, repeated([t for _, t in rows], 200))}
    want = {i: t for i, t in want.items() if re.search(r"[^\x20\x09-\x0D]", t) or t == dict(rows)[i]}
    clean = cpl.repeated_passages(spark, single, SF)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    safe = cpl.secrets(spark, spark.createDataFrame(got, clean.schema), SF)
    assert safe.columns == docs.columns
    safe_rows = safe.collect()
    assert len(safe_rows) == len(got) and not any(find_secrets(r.text) for r in safe_rows)
    assert all(r.text == want[r.doc_id] for r in safe_rows if "[SECRET]" not in r.text)

    packed = cpl.packing(spark, spark.createDataFrame(safe_rows, safe.schema), SF).collect()
    check_packed(packed, 2048)
    assert sum(r.length for r in packed) == sum(len(r.text.split()) for r in safe_rows)


def test_run(spark):
    assert cpl.run(spark, SF).count() > 0
    assert [n for n, _ in cpl.STAGES] == ["quality rules", "near duplicates", "repeated passages", "secrets", "packing"]


def test_stages_on_odd_and_empty_tables(spark):
    for name, stage in cpl.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name
        out = stage(spark, odd(spark), SF).collect()
        assert len(out) <= 10 * len(odd_rows()) + 100 * 7, name
    near = [r.doc_id for r in cpl.near_duplicates(spark, odd(spark), SF).collect()]
    assert sorted(i for i in near if i is not None) == [1, 2, 3, 6, 7, 8, 10, 12, 13]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
