"""URL filter: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: More entries than this are matched by a join instead of a trie in every task.
MAX_TRIE_ENTRIES = 200_000


@dataclass(frozen=True)
class Entry:
    """``host`` and all its subdomains, paths that start with ``path``; ``action`` is allow or block."""
    host: str
    path: str
    action: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dictionaries: host labels from the right, then path segments.

    An entry's path may end inside a segment, so its last segment is kept at the node before
    as a start that the url's next segment must have.
    """

    def __init__(self, entries: Iterable[Entry]):
        self.root: dict = {"hosts": {}, "paths": None}
        for e in entries:
            node = self.root
            for label in reversed(e.host.split(".")) if e.host else ():
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "starts": {}}
            at = node["paths"]
            *whole, last = e.path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "starts": {}})
            have = at["starts"].get(last)
            rule = (e.host + e.path, e.action)
            at["starts"][last] = rule if have is None or e.action == "block" else have

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The entry with the most host labels, then the longest path; block before allow."""
        best = None
        node = self.root
        labels = iter(reversed(host.split("."))) if host else iter(())
        segments = path.split("/")
        while node is not None:
            best = self._below(node["paths"], segments) or best
            label = next(labels, None)
            node = None if label is None else node["hosts"].get(label)
        return best or (None, None)

    @staticmethod
    def _below(at: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at is None:
                break
            starts = at["starts"]
            if starts:
                for n in sorted({len(s) for s in starts}, reverse=True):
                    if n <= len(segment) and segment[:n] in starts:
                        best = starts[segment[:n]]
                        break
            at = at["next"].get(segment)
        return best


def _entries(df: DataFrame) -> list[Entry]:
    return [Entry(*r) for r in df.select("host", "path", "action").distinct().collect()]


def filter_urls(pages: DataFrame, entries: DataFrame | list[Entry], *, url: str = "url", default: str = "allow",
                max_trie_entries: int = MAX_TRIE_ENTRIES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of those names are replaced.

    The deepest entry decides: most host labels, then longest path; block wins a tie. Urls that no
    entry fits get the root's verdict, ``default``, and rule NULL. A NULL url, or one without ``://``,
    has an empty host and path, which only entries with both empty fit. Row order, repeated rows and
    other columns do not matter. A list of at most ``max_trie_entries`` is broadcast as a trie; a longer
    one is joined: each url meets its host's suffixes and the path lengths that entries have.
    """
    spark = pages.sparkSession
    found = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*found, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(entries, DataFrame):
        if entries.limit(max_trie_entries + 1).count() > max_trie_entries:
            return _joined(split, found, entries, default)
        entries = _entries(entries)
    elif len(entries) > max_trie_entries:
        return _joined(split, found, spark.createDataFrame([(e.host, e.path, e.action) for e in entries],
                                                          "host string, path string, action string"), default)
    held = spark.sparkContext.broadcast(list(entries))

    @F.pandas_udf("rule string, action string")
    def looked_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(held.value)
        for hosts, paths in batches:
            yield pd.DataFrame([trie.find(h, p) for h, p in zip(hosts, paths)], columns=["rule", "action"])

    return split.withColumn("_hit", looked_up("host", "path")).select(
        *found, "host", "path", F.col("_hit.rule").alias("rule"),
        F.coalesce(F.col("_hit.action"), F.lit(default)).alias("verdict"))


def _joined(split: DataFrame, found: list[str], entries: DataFrame, default: str) -> DataFrame:
    """The same answer for entry lists of any size, per distinct (host, path)."""
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())
    rules = entries.groupBy("host", "path").agg(F.max("action").alias("action")).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "action")
    urls = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path", F.explode(F.array_union(suffixes, F.array(F.lit("")))).alias("_h"))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")),
                         lambda n: F.substr("path", F.lit(1), n))
    keys = keys.select("host", "path", "_h", F.explode(starts).alias("_p"))
    best = keys.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max(F.struct(
        F.length("_h").alias("n"), F.length("_p").alias("m"), F.concat("_h", "_p").alias("rule"), "action")
    ).alias("_best"))
    return split.join(best, ["host", "path"], "left").select(
        *found, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))
