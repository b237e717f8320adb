"""One query per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .block_max_search import SearchRules, search
from .blob_ledger import listed, scan_history
from .common import table
from .conflict_packing import PackRules, pack_texts
from .language_rank import RankRules, held_out, identify, learn
from .merkle_manifest import digest, encoded, folded, manifest, siblings
from .ordinal_quality import OrdinalRules, fit, grade_texts, rated_rows
from .phrase_graph import mine_phrases
from .prefix_groups import jaccard_join
from .run_index import remove_repeats
from .stream_pieces import decode_ids, encode_texts
from .target_ratio import RatioRules, quality_rules
from .url_trie import Entry, filter_urls
from .window_repeats import remove_copied_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

URL_RULES = [Entry("org", "/", "allow"), Entry("example.org", "/es/", "block"), Entry("example.org", "/en/1", "block"),
             Entry("com", "/fr/", "allow"), Entry("com", "/de/", "block")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op1_ordinal_quality(spark, sf):
    """Expected grade and probability of the top grade of every document."""
    docs, rules = table(spark, sf, "documents").select("doc_id", "text"), OrdinalRules()
    model = fit(rated_rows(docs, table(spark, sf, "labels"), rules), rules)
    return grade_texts(docs, model, rules).select("doc_id", "expected_grade", "p_top", "selected")


@query
def op2_language_rank(spark, sf):
    """Language of every document, learned from the rows that are not held out."""
    docs, rules = table(spark, sf, "documents").select("doc_id", "text", "lang"), RankRules()
    out = held_out(F.col("doc_id"))
    profiles = learn(docs.filter(~out), rules, "text", "lang")
    return identify(docs.select("doc_id", "text", out.alias("held_out")), profiles, rules).select(
        "doc_id", "held_out", "lang_pred", "score")


@query
def op3_conflict_packing(spark, sf):
    """Every document, in pieces of at most 2048 words, packed with at most one of a source in a bin."""
    return pack_texts(table(spark, sf, "documents").select("doc_id", "text", "source"), rules=PackRules(2048))


@query
def op4_blob_ledger(spark, sf):
    """Secrets of every document, each distinct text scanned once."""
    found = scan_history(table(spark, sf, "documents").select("doc_id", "text"))

    def spans(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(spans(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(spans("assign", "access", "hex")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op5_prefix_groups(spark, sf):
    """Near copies of every document: similarity of five-word shingle sets of 0.8 or more."""
    return jaccard_join(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op6_run_index(spark, sf):
    """Every document without the bytes of strings of 200 bytes that also start elsewhere."""
    out = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_block_max_search(spark, sf):
    """The ten best rows for every document whose id is divisible by 100."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return search(docs, F.col("doc_id") % 100 == 0, rules=SearchRules())


@query
def op8_target_ratio(spark, sf):
    """Base counts of every text and the verdict of the likelihood ratio."""
    judged = quality_rules(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"),
                           RatioRules())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "ratio")


@query
def op9_url_trie(spark, sf):
    """Verdict of every page's url."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_stream_pieces(spark, sf):
    """Ids of every document, and whether they decode to its text."""
    ids = encode_texts(table(spark, sf, "documents").select("doc_id", "text"), PIECES)
    back = decode_ids(ids, PIECES)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op11_window_repeats(spark, sf):
    """Every document without the words of 13-word windows that a document of smaller id has too."""
    out = remove_copied_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_phrase_graph(spark, sf):
    """The best phrases of two to four words of every language."""
    return mine_phrases(table(spark, sf, "documents").select("text", "lang"))[0]


@query
def op13_merkle_manifest(spark, sf):
    """Leaf, subroot, root and proof of every document, and whether it still has them after tampering."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf, "documents").select(*columns)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = digest(encoded(*[F.col(c) for c in columns[:-1]], text))
    out = manifest(docs, columns, also={"now": now})
    back = folded(F.col("now"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
                      back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
