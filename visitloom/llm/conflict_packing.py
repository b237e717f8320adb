"""Best-fit packing of texts into bins of one capacity, under conflicts.

A bin holds at most one text of each source and one of each duplicate cluster. Texts are dealt to shards by
hash; each shard packs its own by decreasing length: bins are ordered by residual, each with a bitmap
of its sources and one of its clusters, and a text goes into the first bin from the tightest fit upwards
whose bitmaps do not have its bits.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE
from .shared import kept


@dataclass(frozen=True)
class PackRules:
    """``capacity`` in the unit of the lengths; a shard gets about ``shard_items`` pieces."""
    capacity: int = 2048
    shard_items: int = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")), F.lit(0)).cast("long")


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of every item; items come in the order in which they are to be placed."""
    bit = {}
    source_bits = [1 << bit.setdefault(s, len(bit)) for s in sources]
    times: dict = {}
    for c in clusters:
        times[c] = times.get(c, 0) + 1
    shared = {c: 1 << i for i, c in enumerate(c for c, n in times.items() if n > 1)}
    cluster_bits = [shared.get(c, 0) for c in clusters]
    order: list[tuple[int, int]] = []          # (residual, bin), open bins only
    in_sources, in_clusters, out = [], [], []
    for length, s, c in zip(lengths, source_bits, cluster_bits):
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (in_sources[b] & s or in_clusters[b] & c):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(in_sources)
            in_sources.append(0)
            in_clusters.append(0)
        out.append((b, capacity - residual))
        in_sources[b] |= s
        in_clusters[b] |= c
        if residual > length:
            insort(order, (residual - length, b))
    return out


def pack_texts(docs: DataFrame, *, key: str = "doc_id", length: Column | None = None, source: str = "source",
               cluster: Column | None = None, text: str = "text", rules: PackRules = PackRules()) -> DataFrame:
    """One row per piece: key, piece, start, length, bin, offset.

    ``length`` (words by default) above the capacity makes full pieces and a rest; pieces of a text
    are in different bins, as they share its source. A text of length 0 or NULL is one row with bin and offset
    NULL. NULL sources are one source, NULL keys are kept; ``cluster`` (hash of the folded text by
    default) NULL conflicts with nothing. Ties in length are placed by key, piece and cluster. Equal rows
    are packed each; an empty table gives no rows. Bins never go over a shard, so a hot source fills as many
    bins as it has pieces and no task sees more than a shard.
    """
    length = word_count(F.col(text)) if length is None else length
    cluster = F.xxhash64(F.lower(F.col(text))) if cluster is None else cluster
    items = kept(docs.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("total"),
                             F.col(source).cast("string").alias("source"), cluster.cast("string").alias("cluster")),
                 "items")
    cap = rules.capacity
    pieces = F.ceil(F.col("total") / cap).cast("int")
    n = items.agg(F.sum(pieces.cast("long"))).first()[0] or 0
    shards = max(1, -(-n // rules.shard_items))
    cut = items.filter("total > 0").select(
        "key", "total", "source", "cluster", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.select("key", "piece", (F.col("piece").cast("long") * cap).alias("start"), F.least(
        F.lit(cap).cast("long"), F.col("total") - F.col("piece").cast("long") * cap).alias("length"),
        "source", "cluster", F.pmod(F.xxhash64("key", "piece", "cluster"), F.lit(shards)).alias("shard"))
    kind = items.schema["key"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "key", "piece", "cluster"], ascending=[False, True, True, True],
                                  kind="stable", ignore_index=True)
        clusters = [object() if c is None else c for c in group["cluster"]]
        placed = pack(group["length"].tolist(), group["source"].tolist(), clusters, cap)
        first = int(group["shard"].iloc[0]) << 32 if len(group) else 0
        return group.assign(bin=[first + b for b, _ in placed], offset=[o for _, o in placed])[
            ["key", "piece", "start", "length", "bin", "offset"]]

    packed = cut.groupBy("shard").applyInPandas(
        run, f"key {kind}, piece int, start long, length long, bin long, offset long")
    none = items.filter("total <= 0").select(
        "key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
        F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(none).withColumnRenamed("key", key)
