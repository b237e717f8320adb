"""Exact quantiles with linear interpolation, for groups and columns of any size.

``percentile`` keeps every distinct value of a group in one buffer.  For groups
(:func:`exact_quantiles`) the values are counted first (with map-side combine), the counts
are summed in value order by :func:`running`, and the wanted ranks are picked out.  For whole columns
(:func:`column_quantiles`) the ranks are bracketed, and only values inside the brackets are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import number_or_null
from .ordered import ROWS_PER_TASK, running

PART = 100      # cells of a task, at most

def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *,
                    moments: bool = False, rows_per_task: int = ROWS_PER_TASK,
                    at_most: DataFrame | None = None) -> DataFrame:
    """One row per group with one column per entry of ``probs``; NULL and NaN are ignored.

    With ``moments`` the row also has ``count``, ``mean``, ``std`` (sample), ``min`` and
    ``max``, from the same counted values.  ``at_most``: see :func:`running`.
    """
    keys = list(keys)
    counted = (df.filter(number_or_null(F.col(value)).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_q_value"))
               .agg(F.count(F.lit(1)).alias("_q_count")))
    v, c, b, n = (F.col(f"_q_{x}") for x in ("value", "count", "before", "total"))
    group = {"_q_total": ("sum", c)}
    if moments:
        group["_q_sum"] = ("sum", v * c)
    cum = running(counted, keys, [v], [v], before={"_q_before": ("sum", c)}, group=group,
                  rows_per_task=rows_per_task, at_most=at_most)

    def at(rank):
        return F.max(F.when((b <= rank) & (rank < b + c), v))

    aggs = [F.max("_q_total").alias("_q_total")]
    for name, p in probs.items():
        h = (n - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
    if moments:   # squares around the known mean, so nothing cancels
        mean = F.col("_q_sum") / n
        aggs += [F.max(mean).alias("mean"), F.sum(c * F.pow(v - mean, 2)).alias("_q_squares"),
                 F.min("_q_value").alias("min"), F.max("_q_value").alias("max")]
    picked = cum.groupBy(*keys).agg(*aggs)

    def blend(name, p):
        h = (n - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (h - F.floor(h))).alias(name)

    extra = [n.alias("count"), "mean", F.sqrt(F.col("_q_squares") / F.when(n > 1, n - 1)).alias("std"),
             "min", "max"] if moments else []
    return picked.select(*keys, *[blend(q, p) for q, p in probs.items()], *extra)


@dataclass
class _Bracket:
    """Values ``lo`` to ``hi`` of a column, in which the wanted ranks are; ``below`` values are smaller."""

    column: int
    prob: str
    first: int
    last: int
    share: float
    lo: float
    hi: float
    below: int = 0
    inside: int = 0

    def holds(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside


def _number(name: str) -> str:
    """SQL of a column as a number, NULL for NaN."""
    cell = "CAST(`" + name.replace("`", "``") + "` AS DOUBLE)"
    return f"CASE WHEN NOT isnan({cell}) THEN {cell} END"


def _inside(x: Sequence[str], b: _Bracket) -> str:
    return f"({x[b.column]} BETWEEN double('{b.lo!r}') AND double('{b.hi!r}'))"


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float], *, accuracy: int = 2000,
                     enough: int = 200_000) -> DataFrame:
    """Exact quantiles, count, mean, sample std, min and max of many columns: a row per column, NULL and NaN left out.

    A selection, not a sort.  One pass makes a sketch per column, whose error bounds bracket every wanted rank between
    two values.  The next counts what is below and inside each bracket (and sums squares around the means).  While
    more than ``enough`` values are inside, they are sketched again and the bracket shrinks by about ``accuracy / 4``.
    Only then are values shuffled: those inside the brackets, counted by value first.  All other passes send
    a row per task and column.  ``df`` is read three times or more, so it should be a stored table.  ``accuracy`` and ``enough`` do not
    change the answer.
    """
    spark, names = df.sparkSession, list(columns)
    schema = ("column string, n_rows long, count long, mean double, std double, min double, max double, "
              + ", ".join(f"{p} double" for p in probs))
    x = [_number(c) for c in names]        # as text: wide tables have hundreds of columns
    slack = 2.0 / accuracy

    def sketch(value: str, shares: Sequence[float]) -> str:
        near = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
        return f"percentile_approx({value}, array({', '.join(f'double({str(s)!r})' for s in near)}), {accuracy})"

    seen = {r["cell"]: r for r in _cells(df, x, range(len(x))).groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.expr(sketch("value", list(probs.values()))).alias("near")).collect()} if x else {}
    none = {"rows": 0, "n": 0, "mean": None, "min": None, "max": None, "near": None}
    stats = [seen.get(i, none) for i in range(len(names))]
    brackets = []
    for i, s in enumerate(stats):
        for at, (name, p) in enumerate(probs.items()):
            if s["n"]:
                h = (s["n"] - 1) * p
                brackets.append(_Bracket(i, name, math.floor(h), math.ceil(h), h - math.floor(h),
                                         s["near"][2 * at], s["near"][2 * at + 1]))
    outer = {(b.column, b.prob): replace(b, lo=stats[b.column]["min"], hi=stats[b.column]["max"],
                                         inside=stats[b.column]["n"]) for b in brackets}

    def counted(todo: list[_Bracket], means: dict[int, float]) -> dict[int, float]:
        """Counts below and inside the brackets; for every column with a mean, its squares around it."""
        rest = dict(means)      # a column's first cell has its mean
        cells = [(b.column, b.lo, b.hi, rest.pop(b.column, None)) for b in todo]
        cells += [(i, None, None, m) for i, m in rest.items()]
        if not cells:
            return {}
        rows = {r["cell"]: r for r in _compared(df, x, cells).groupBy("cell").agg(
            F.count_if("below").alias("below"), F.count_if("inside").alias("inside"),
            F.sum(F.expr("power(value - mean, 2)")).alias("squares")).collect()}       # a row per cell
        for j, b in enumerate(todo):
            b.below, b.inside = (rows[j]["below"], rows[j]["inside"]) if j in rows else (0, 0)
        return {cells[j][0]: r["squares"] for j, r in rows.items() if cells[j][3] is not None}

    squares = counted(brackets, {i: s["mean"] for i, s in enumerate(stats) if s["n"] > 1})
    std = [math.sqrt(squares[i] / (s["n"] - 1)) if s["n"] > 1 else None for i, s in enumerate(stats)]
    brackets = [b if b.holds() else outer[b.column, b.prob] for b in brackets]
    while wide := [j for j, b in enumerate(brackets) if b.inside > enough and b.lo < b.hi]:
        near = df.agg(*[F.expr(sketch(f"CASE WHEN {_inside(x, b)} THEN {x[b.column]} END", [
            (r - b.below) / max(1, b.inside - 1) for r in (b.first, b.last)])).alias(f"b{j}")
            for j, b in ((j, brackets[j]) for j in wide)]).first()
        tighter = [replace(brackets[j], lo=near[f"b{j}"][0], hi=near[f"b{j}"][-1]) for j in wide]
        counted(tighter, {})
        moved = False
        for j, b in zip(wide, tighter):
            if b.holds() and b.inside < brackets[j].inside:
                moved |= 2 * b.inside <= brackets[j].inside
                brackets[j] = b
        if not moved:       # what is left inside are repeats of few values
            break
    found = {(b.column, b.prob): b.lo for b in brackets if b.lo == b.hi}
    open_ = [(j, b) for j, b in enumerate(brackets) if b.lo < b.hi]
    if open_:
        for r in _picked(bracketed_values(df, x, open_), open_).collect():      # a row per bracket
            b = brackets[r["bracket"]]
            found[b.column, b.prob] = r["lo"] + (r["hi"] - r["lo"]) * b.share if r["hi"] > r["lo"] else r["lo"]
    return spark.createDataFrame([
        (c, s["rows"], s["n"], s["mean"], std[i], s["min"], s["max"], *[found.get((i, p)) for p in probs])
        for i, (c, s) in enumerate(zip(names, stats))], schema)


def _cells(df: DataFrame, x: Sequence[str], columns: Sequence[int]) -> DataFrame:
    """``cell, value``: columns as rows, numbered in the given order.

    A few aggregates by cell take a fraction of the time of several per column side by side.  A task has the cells
    of one part only, as Spark aggregates objects (sketches) by sorting above 128 keys.
    """
    parts, columns = [], list(columns)
    for at in range(0, len(columns), PART):
        values = F.expr("array(" + ", ".join(x[c] for c in columns[at:at + PART]) + ")")
        parts.append(df.select(F.posexplode(values).alias("cell", "value")).withColumn("cell", F.col("cell") + at))
    return reduce(DataFrame.unionByName, parts)


def _compared(df: DataFrame, x: Sequence[str], cells: Sequence[tuple[int, float | None, float | None, float | None]]) -> DataFrame:
    """``cell, value, below, inside, mean`` of every value of the column of a cell ``(column, lo, hi, mean)``."""
    def listed(numbers) -> str:
        return "array(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"double('{v!r}')" for v in numbers) + ")"

    lo, hi, mean = (F.expr(f"get({listed(part)}, cell)") for part in zip(*[c[1:] for c in cells]))
    v = F.col("value")
    return _cells(df, x, [c for c, *_ in cells]).filter(v.isNotNull()).select(
        "cell", "value", (v < lo).alias("below"), v.between(lo, hi).alias("inside"), mean.alias("mean"))


def bracketed_values(df: DataFrame, x: Sequence[str], brackets: Sequence[tuple[int, _Bracket]]) -> DataFrame:
    """``bracket, value, n``: how often each value inside a bracket occurs; the only cells that are shuffled."""
    inside = _compared(df, x, [(b.column, b.lo, b.hi, None) for _, b in brackets]).filter("inside")
    number = F.expr(f"get(array({', '.join(str(j) for j, _ in brackets)}), cell)")
    return inside.groupBy(number.alias("bracket"), "value").agg(F.count(F.lit(1)).alias("n"))


def _picked(values: DataFrame, brackets: Sequence[tuple[int, _Bracket]]) -> DataFrame:
    """The values at the first and the last wanted rank of every bracket."""
    order = Window.partitionBy("bracket").orderBy("value")      # a bracket holds few distinct values by now
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.broadcast(values.sparkSession.createDataFrame(     # as many rows as brackets
        [(j, b.first - b.below, b.last - b.below) for j, b in brackets], "bracket int, first long, last long"))
    placed = values.withColumn("ahead", ahead).join(ranks, "bracket")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("ahead") <= F.col(rank)) & (F.col(rank) < F.col("ahead") + F.col("n")), F.col("value")))

    return placed.groupBy("bracket").agg(at("first").alias("lo"), at("last").alias("hi"))
