"""Seeded changes of observation data for robustness checks.

Every decision is a function of the seed and of the row's own identity, so it
does not depend on partitioning, row order, column order or other entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import plus_days, require_columns, row_cuts, sort_cuts, uniform
from ..spec import Condition, VisitSpec
from .ordered import first_rows, positions, running


def _share(fraction: float) -> None:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")


def remove_measurements(obs: DataFrame, spec: VisitSpec, fraction: float, *, seed: int = 42,
                        columns: list[str] | None = None) -> DataFrame:
    """Blank each (entity, visit, feature) cell with probability ``fraction``."""
    _share(fraction)
    require_columns(obs, [spec.entity, *spec.order], "remove_measurements")
    chosen = [c for c in (columns if columns is not None else (*spec.numeric, *spec.categorical))
              if c in obs.columns]
    return obs.withColumns({
        c: F.when(uniform(seed, F.lit("remove_measurements"), spec.entity, *spec.order, F.lit(c)) >= fraction,
                  F.col(c)) for c in chosen})


def blanked_cells(before: DataFrame, spec: VisitSpec, fraction: float, *, seed: int = 42,
                  columns: list[str] | None = None) -> DataFrame:
    """Per feature: cells in the table and cells chosen for blanking."""
    _share(fraction)
    chosen = [c for c in (columns if columns is not None else (*spec.numeric, *spec.categorical))
              if c in before.columns]
    hit = {c: uniform(seed, F.lit("remove_measurements"), spec.entity, *spec.order, F.lit(c)) < fraction
           for c in chosen}
    counts = before.groupBy().agg(F.count(F.lit(1)).alias("cells_total"),
                                  *[F.count_if(h).alias(c) for c, h in hit.items()])
    return counts.unpivot(["cells_total"], chosen, "feature", "cells_blanked").select(
        "feature", "cells_total", "cells_blanked")


def remove_visits(obs: DataFrame, spec: VisitSpec, fraction: float, *, seed: int = 42,
                  min_visits_kept: int = 1, **kw) -> DataFrame:
    """Drop ``floor(n * fraction)`` visits per entity, but keep at least ``min_visits_kept``."""
    _share(fraction)
    if min_visits_kept < 1:
        raise ValueError("min_visits_kept must be at least 1")
    drawn = obs.withColumn("_u", uniform(seed, F.lit("remove_visits"), spec.entity, *spec.order))
    ranked = positions(drawn, [spec.entity], [F.col("_u"), *[F.col(c) for c in spec.order]],
                       [F.col("_u"), *sort_cuts(obs, spec.order)], "_i", total="_n", **kw)
    drop = F.least(F.floor(F.col("_n") * F.lit(fraction)),
                   F.greatest(F.lit(0).cast("long"), F.col("_n") - min_visits_kept))
    return ranked.filter(F.col("_i") >= drop).drop("_u", "_i", "_n")


def truncate_to_recent_visits(obs: DataFrame, spec: VisitSpec, keep_last: int, **kw) -> DataFrame:
    """The last ``keep_last`` visits of every entity."""
    if keep_last < 1:
        raise ValueError("keep_last must be at least 1")
    return first_rows(obs, [spec.entity], [F.col(c).desc() for c in spec.order], keep_last,
                      cuts=row_cuts(obs, spec.order, newest=True), **kw).drop("_rank")


def thin_followup(obs: DataFrame, spec: VisitSpec, keep_last: int, *, seed: int = 42) -> DataFrame:
    """Older name of :func:`truncate_to_recent_visits`; the seed has no effect."""
    return truncate_to_recent_visits(obs, spec, keep_last)


def jitter_visit_timing(obs: DataFrame, spec: VisitSpec, max_shift: int, *, seed: int = 42, **kw) -> DataFrame:
    """Shift every date by whole days in ``[-max_shift, max_shift]``.

    Dates stay inside the entity's own span, and a running maximum keeps the
    visits in their original order.
    """
    if max_shift < 0:
        raise ValueError("max_shift must not be negative")
    if max_shift == 0:
        return obs
    t, order, cuts = spec.time, [F.col(c) for c in spec.order], sort_cuts(obs, spec.order)
    u = uniform(seed, F.lit("jitter_visit_timing"), spec.entity, *spec.order)
    shift = (F.floor(u * (2 * max_shift + 1)) - max_shift).cast("int")
    # The clamp only caps a running maximum, so it can follow it: max(min(max(d, lo), hi))
    # over earlier rows equals min(max(running max of d, lo), hi).
    moved = obs.withColumn("_moved", plus_days(obs, t, shift))
    span = running(moved, [spec.entity], order, cuts, before={"_top": ("max", F.col("_moved"))},
                   group={"_lo": ("min", F.col(t)), "_hi": ("max", F.col(t))}, **kw)
    new = F.least(F.greatest(F.col("_moved"), F.col("_top"), F.col("_lo")), F.col("_hi"))
    return span.withColumn(t, new).select(*obs.columns)


def condition_record(before: DataFrame, after: DataFrame, spec: VisitSpec, condition: Condition) -> DataFrame:
    """One row: what was done, and how many entities and visits there were before and after."""
    def size(df, tag):
        return df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n")).groupBy().agg(
            F.count(F.lit(1)).alias(f"entities_{tag}"), F.sum("_n").alias(f"visits_{tag}"),
        ).withColumn("_k", F.lit(1))

    both = size(before, "before").join(size(after, "after"), "_k").drop("_k")   # one row each
    params = F.create_map(*[F.lit(x) for k, v in condition.params.items() for x in (k, str(v))]) \
        if condition.params else F.create_map().cast("map<string,string>")
    return both.select(
        F.lit(condition.kind).alias("kind"), F.lit(condition.strength).cast("double").alias("strength"),
        params.alias("params"), "entities_before", "entities_after", "visits_before", "visits_after")
