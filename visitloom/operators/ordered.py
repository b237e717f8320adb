"""Running totals and positions inside groups of any size.

A window over ``partitionBy(key)`` sends every row of a key to one task.  That
is fine while groups are small, and it stops working when one key holds a third
of the table or when there is no key at all (a ranking over all rows).

:func:`running` therefore first counts the groups.  Groups of at most
``rows_per_task`` rows use an ordinary window.  Larger ones are cut into value
ranges; the window runs inside (key, range), and the totals of the earlier
ranges, a table with one row per range, are added from a broadcast.  Ranges are
found with ``percentile_approx``, collected once and planted as constants, so a
retried task sees the same ranges.  The answer is exact in both cases.

What is collected and broadcast: only groups with more than ``rows_per_task``
rows, so at most ``rows / rows_per_task`` of them, with two bounds for every
``rows_per_task`` rows and at most ``MAX_RANGES`` per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

ROWS_PER_TASK = 5_000_000
MAX_RANGES = 1024
STRIDE = 32
GROUP_LIMIT = 1000         # spark.sql.optimizer.windowGroupLimitThreshold

_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a small table whose size the caller has bounded."""
    renamed = small.select(*[
        F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in small.columns])
    on = None
    for k in keys:
        same = df[k].eqNullSafe(renamed[f"_k_{k}"])
        on = same if on is None else on & same
    return df.join(F.broadcast(renamed), on, "left").drop(*[f"_k_{k}" for k in keys])


def _large_groups(df: DataFrame, groups: list[str], cut: Column, rows_per_task: int,
                  single: str | None) -> DataFrame | None:
    """Bounds for the groups that one task should not hold, or None."""
    counted = df.select(*groups)
    if single:   # below the first level only ranges made of one repeated value can be cut
        counted = counted.filter(F.col(single) % 2 == 1)
    rows = (counted.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
            .filter(F.col("_rows") > rows_per_task).collect())
    if not rows:
        return None
    spark = df.sparkSession
    keys = T.StructType([df.schema[g] for g in groups])
    hot = spark.createDataFrame([tuple(r[g] for g in groups) for r in rows], keys)
    largest = max(r["_rows"] for r in rows)
    ranges = min(MAX_RANGES, max(2, 2 * math.ceil(largest / rows_per_task)))
    probs = [i / ranges for i in range(1, ranges)]
    marked = _attach(df.select(*groups, cut.alias("_cut")), hot.withColumn("_hot", F.lit(True)), groups)
    # All groups share one list of probabilities; each keeps as many bounds as its own size asks for.
    wanted = F.least(F.lit(ranges), F.greatest(
        F.lit(2), F.ceil(F.lit(2.0) * F.col("_rows") / rows_per_task))).cast("int")
    kept = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get(
        "_quantiles", F.floor(i * F.lit(ranges) / wanted).cast("int") - 1))
    bounds = (marked.filter("_hot").groupBy(*groups)
              .agg(F.percentile_approx("_cut", probs, 20 * ranges).alias("_quantiles"),
                   F.count(F.lit(1)).alias("_rows"))
              .select(*groups, F.array_sort(F.array_distinct(kept)).alias("_bounds")).collect())
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(list(keys) + [T.StructField("_bounds", doubles), T.StructField("_coarse", doubles)])
    return spark.createDataFrame(
        [tuple(r) + (r["_bounds"][STRIDE - 1::STRIDE],) for r in bounds], schema)


def _cut_into_ranges(df: DataFrame, groups: list[str], cut: Column, bounds: DataFrame,
                     name: str, flag: bool) -> DataFrame:
    """Number the value ranges: 2i between two bounds, 2i+1 exactly on a bound."""
    out = _attach(df, bounds, groups).withColumn("_cut", cut).withColumn(name, F.lit(0))
    if flag:
        out = out.withColumn("_large", F.col("_bounds").isNotNull())
    # Two scans of about the square root of the number of bounds, not one of all of them.
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("_cut")))
    out = (out.withColumn("_skip", F.coalesce(below(F.col("_coarse")), F.lit(0)) * STRIDE)
           .withColumn(name, F.when(F.col("_bounds").isNull(), 0).otherwise(
               F.col("_skip") + below(F.slice("_bounds", F.col("_skip") + 1, F.lit(STRIDE))))))
    on_bound = F.coalesce(F.get("_bounds", F.col(name)) == F.col("_cut"), F.lit(False))
    return (out.withColumn(name, F.when(F.col("_bounds").isNull(), 0)
                           .otherwise(2 * F.col(name) + on_bound.cast("int")))
            .drop("_bounds", "_coarse", "_skip", "_cut"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cuts: Sequence[Column], *,
            before: dict[str, tuple[str, Column | None]],
            group: dict[str, tuple[str, Column]] | None = None,
            rows_per_task: int = ROWS_PER_TASK, bounded: bool = False,
            at_most: DataFrame | None = None) -> DataFrame:
    """Add running values (rows strictly before, in ``order``) and group totals.

    ``before`` and ``group`` map a new column to ``(function, column)`` with function
    ``sum``, ``max`` or ``min``; ``before`` also takes ``("count", None)``, the
    0-based position, and ``group`` also ``last``, the last value that is not NULL
    (``order`` then has plain columns, all rising).  ``cuts`` are numbers that never decrease along ``order``,
    the first for the first sort column and so on.  ``bounded=True`` says that the
    caller knows every group fits one task, and saves the count.  ``at_most`` is a
    table with at least as many rows as any group; when it is cheaper to count and
    small enough, the groups need no counting.
    """
    if at_most is not None and not bounded:
        bounded = at_most.count() <= rows_per_task
    group = group or {}
    keys = list(keys)
    added = not keys
    if added:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]

    inputs = {**{f"_in_{n}": c for n, (f, c) in before.items() if f != "count"},
              **{f"_in_{n}": c for n, (_, c) in group.items()}}
    df = df.withColumns(inputs) if inputs else df
    ranges: list[str] = []
    if not bounded:
        for level, cut in enumerate(cuts):
            groups = keys + ranges
            bounds = _large_groups(df, groups, cut, rows_per_task, ranges[-1] if ranges else None)
            if bounds is None:
                break
            df = _cut_into_ranges(df, groups, cut, bounds, f"_range{level}", flag=not ranges)
            ranges.append(f"_range{level}")

    part = Window.partitionBy(*keys, *ranges)
    ordered = part.orderBy(*order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    unbounded = (Window.unboundedPreceding, Window.unboundedFollowing)

    def inside(name: str, fn: str) -> Column:
        if fn == "count":
            return (F.row_number().over(ordered) - 1).cast("long")
        return _FOLD[fn](f"_in_{name}").over(earlier)

    def total(name: str, fn: str) -> Column:
        if fn == "last":
            return F.last(f"_in_{name}", ignorenulls=True).over(ordered.rowsBetween(*unbounded))
        return _FOLD[fn](f"_in_{name}").over(part)

    if not ranges:
        new = {n: inside(n, f) for n, (f, _) in before.items()}
        new = {n: F.coalesce(c, F.lit(0)) if before[n][0] == "sum" else c for n, c in new.items()}
        new |= {n: total(n, f) for n, (f, _) in group.items()}
        out = df.withColumns(new)
    else:
        # One row per range of the large groups; small groups have one range and need none of it.
        def of_range(name: str, fn: str) -> Column:
            v = F.col(f"_in_{name}")
            return F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) if fn == "last" else _FOLD[fn](v)

        per_range = df.filter("_large").groupBy(*keys, *ranges).agg(
            *[(F.count(F.lit(1)) if f == "count" else _FOLD[f](f"_in_{n}")).alias(f"_t_{n}")
              for n, (f, _) in before.items()],
            *[of_range(n, f).alias(f"_g_{n}") for n, (f, _) in group.items()])
        whole = Window.partitionBy(*keys)
        prior = whole.orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
        fold = {n: "sum" if f == "count" else f for n, (f, _) in before.items()}

        def of_group(name: str, fn: str) -> Column:
            if fn == "last":
                return F.last(f"_g_{name}", ignorenulls=True).over(whole.orderBy(*ranges).rowsBetween(*unbounded))
            return _FOLD[fn](f"_g_{name}").over(whole)

        offsets = per_range.select(
            *keys, *ranges,
            *[_FOLD[f](f"_t_{n}").over(prior).alias(f"_o_{n}") for n, f in fold.items()],
            *[of_group(n, f).alias(f"_w_{n}") for n, (f, _) in group.items()])
        local = df.withColumns({
            **{f"_i_{n}": inside(n, f) for n, (f, _) in before.items()},
            **{f"_p_{n}": F.when(~F.col("_large"), total(n, f)) for n, (f, _) in group.items()}})
        joined = _attach(local, offsets, keys + ranges)
        out = joined.withColumns({
            **{n: _MERGE[f](F.col(f"_o_{n}"), F.col(f"_i_{n}")) for n, f in fold.items()},
            **{n: F.coalesce(F.col(f"_w_{n}"), F.col(f"_p_{n}")) for n in group}})
        out = out.drop(*[f"{p}{n}" for n in before for p in ("_o_", "_i_")],
                       *[f"{p}{n}" for n in group for p in ("_w_", "_p_")], *ranges, "_large")
    return out.drop(*inputs, *(["_all"] if added else []))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cuts: Sequence[Column],
              name: str, *, total: str | None = None, **kw) -> DataFrame:
    """0-based position inside the group, and optionally the group size."""
    group = {total: ("sum", F.lit(1).cast("long"))} if total else {}
    return running(df, keys, order, cuts, before={name: ("count", None)}, group=group, **kw)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
               name: str = "_rank", *, cuts: Sequence[Column] | None = None, **kw) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank.

    Spark keeps at most ``n`` rows per key in each map task before the shuffle
    (window group limit), so a key of any size reaches the reducer as few rows.  Beyond the
    ``GROUP_LIMIT`` of Spark the positions are counted over ranges instead; pass their ``cuts``.
    """
    if n > GROUP_LIMIT and cuts is not None:
        placed = positions(df, keys, order, cuts, name, **kw)
        return placed.withColumn(name, F.col(name) + 1).filter(F.col(name) <= n)
    return (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(name) <= n))
