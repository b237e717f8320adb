"""Merkle trees over the rows of every group and over the groups, built by self-joins on computed sibling indices.

Rows are put in order by a range partitioning, so a group of any size is spread over many tasks; a row's index is its
place in its partition plus the rows of earlier partitions. On every level each node is joined with the
nodes at the other slots of its run (for two slots the index with its last bit flipped, else an offset round the run), and
the node in slot zero emits the parent. The siblings that a node met stay with it as one step of a proof. Proofs then
grow from the root down: a node's path is its own step and its parent's path, so the work shrinks with the levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepare, shield
from .shared import Scratch, tidy

STEP = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class TreeRules:
    """``arity``: nodes in a run."""
    arity: int = 3

    def __post_init__(self) -> None:
        if self.arity < 2:
            raise ValueError("a run has two nodes or more")


def encoded(*values: Column) -> Column:
    """The values one after another, each as byte count, colon and text, or a dash where it is NULL."""
    def one(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.concat(*[one(v) for v in values])


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(text, 256)


def placed(rows: DataFrame, room: Scratch, *order: str) -> DataFrame:
    """``rows`` with idx, the place (from 0) in their ``tree``, and n, the rows of the tree.

    One range partitioning by tree and order; rows that are equal in all of these have any order, and do not share a
    partition. The rows of one tree in earlier partitions are summed over one row per partition and tree.
    """
    salted = room.kept(rows).withColumn("_salt", F.monotonically_increasing_id())
    at = room.kept(salted.repartitionByRange("tree", *order, "_salt").sortWithinPartitions("tree", *order, "_salt")
                   .withColumn("_at", F.monotonically_increasing_id()).drop("_salt"))
    part = F.shiftright("_at", 33)
    parts = at.groupBy(part.alias("_part"), "tree").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", "tree", "_first", F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_rows").over(tree).alias("n"))
    return at.withColumn("_part", part).join(parts, ["_part", "tree"]).withColumn(
        "idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def climb(nodes: DataFrame, rules: TreeRules, room: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, tops): nodes below a parent with the step of their proof, and the nodes that have none, by level.

    ``nodes`` has tree, idx, n, h and any further columns, which stay on the lowest level.
    """
    k = rules.arity
    levels, tops = [], []
    nodes = room.kept(nodes)
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        slot = F.pmod("idx", F.lit(k))
        met = nodes.filter("n > 1").withColumn("_slot", slot)
        for shift in range(1, k):      # the node that is ``shift`` slots on, round the run, tells this one
            if k == 2:
                wants = F.col("idx").bitwiseXOR(F.lit(1))
            else:
                wants = F.col("idx") - slot + F.pmod(slot - shift, F.lit(k))
            told = nodes.filter("n > 1").select("tree", wants.alias("idx"), F.col("h").alias(f"_h{shift}"))
            met = met.join(told, ["tree", "idx"], "left")

        def at(place: int) -> Column:
            """The sibling in the run's slot ``place``; empty where there is none."""
            return F.coalesce(*[F.when(F.pmod(F.col("_slot") + s, F.lit(k)) == place, F.col(f"_h{s}"))
                                for s in range(1, k)], F.lit(""))

        before = F.concat(*[F.when(F.col("_slot") > p, at(p)).otherwise("") for p in range(k)])
        after = F.concat(*[F.when(F.col("_slot") < p, at(p)).otherwise("") for p in range(k)])
        step = F.struct(before.alias("before"), after.alias("after"))
        parent = F.when(F.col("_slot") == 0, digest(F.concat("h", after)))
        level = room.kept(met.select(*nodes.columns, step.alias("step"), parent.alias("_parent")))
        tops.append(nodes.filter("n = 1"))
        levels.append(level.drop("_parent"))
        nodes = level.filter("_parent is not null").select(
            "tree", F.expr(f"idx div {k}").alias("idx"), F.expr(f"(n + {k - 1}) div {k}").alias("n"),
            F.col("_parent").alias("h"))
        largest = -(-largest // k)
    tops.append(nodes.filter("n = 1"))
    return levels, tops


def descend(levels: list[DataFrame], tops: list[DataFrame], ends: DataFrame, rules: TreeRules) -> DataFrame:
    """The lowest nodes with path, the steps up to the end of their tree and on, and the other columns of ``ends``.

    ``ends`` has a row per tree: tree, path (the steps above the tree's top) and further columns.
    """
    extra = [c for c in ends.columns if c not in ("tree", "path")]
    found = None
    for at in range(len(levels), -1, -1):
        top = tops[at].join(ends, "tree")
        if found is None:
            here = top
        else:
            above = found.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"), *extra)
            level = levels[at].withColumn("_up", F.expr(f"idx div {rules.arity}"))
            here = level.join(above, ["tree", "_up"]).withColumn(
                "path", F.concat(F.array("step"), "_path")).drop("_up", "_path", "step").unionByName(top)
        found = here
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a proof, in order from the leaf to the root."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *,
             key: str = "doc_id", group: str = "source", also: dict[str, Column] | None = None,
             rules: TreeRules = TreeRules()) -> DataFrame:
    """One row per row of ``docs``: key, group, the columns of ``also``, leaf, subroot, root and path.

    A leaf is the digest of the encoded values of ``columns``; leaves of a group ascend by key (NULL first, equal keys
    by leaf, equal leaves are the same leaf). Every run of ``arity`` nodes becomes its digest until one node is left, the
    subroot; a lone leaf is its own. Groups are ordered bytewise, the NULL group first, and their subroots
    make the root likewise. path holds the siblings before and after the node on each level, from the leaf via the subroot to the
    root; the last run of a level may lack some. NULLs, empty texts and repeated rows are leaves like others. An empty
    table gives no rows. Further columns of ``docs`` are not part of a leaf and not returned. ``also`` are
    expressions over the names in ``columns``, ``key`` and ``group``.
    """
    spark = tidy(prepare(docs.sparkSession))
    room = Scratch(spark, "merkle")
    names = list(dict.fromkeys((*columns, key, group)))
    inner, _, roles = shield(docs, (), *names)
    rows = inner.select(*[F.col(r).alias(n) for r, n in zip(roles, names)])

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    also = also or {}
    leaves = rows.select(
        F.struct(col(key).alias("key"), col(group).alias("group"), *[c.alias(n) for n, c in also.items()]).alias("own"),
        F.coalesce(F.concat(F.lit("g"), col(group).cast("string")), F.lit("-")).alias("tree"),
        col(key).alias("_key"), digest(encoded(*[col(c) for c in columns])).alias("h"))
    low = placed(leaves, room, "_key", "h").drop("_key")
    levels, tops = climb(low, rules, room)
    subroots = tops[0].select("tree", "h")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("tree", "h"))
    heads = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "h")
    high_levels, high_tops = climb(placed(heads, room, "_group"), rules, room)
    roots = high_tops[-1].select("tree", F.array().cast(STEP).alias("path"), F.col("h").alias("root"))
    ends = descend(high_levels, high_tops, roots, rules).select(
        F.col("_group").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    ends = room.kept(ends)
    found = descend(levels, tops, ends, rules)
    return found.select(F.col("own.key").alias(key), F.col("own.group").alias(group),
                        *[F.col(f"own.`{n}`").alias(n) for n in also],
                        F.col("h").alias("leaf"), "subroot", "root", "path")
