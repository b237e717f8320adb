"""One row per entity: visit waves, temporal summaries, latest categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import missing_to_null, number_or_null, require_columns, sort_cuts
from ..spec import DataError, VisitSpec
from .guards import refuse_leakage
from .ordered import running

SUMMARIES = ("latest", "mean", "min", "max", "std", "delta", "slope")
COUNT_COLUMN = "n_obs_visits"

# The catalogue's name of each summary. The descriptions are this library's own.
TRANSFORMATIONS = {
    "latest": ("latest", "the entity's newest known value"),
    "mean": ("mean", "average of the known values"),
    "min": ("min", "least known value"),
    "max": ("max", "greatest known value"),
    "std": ("std", "standard deviation (n - 1) of the known values, NULL below two"),
    "delta": ("last_minus_first", "newest known value less the oldest, NULL below two"),
    "slope": ("linear_slope", "least-squares change per visit over the known values, NULL below two"),
}


def wide_features(obs: DataFrame, spec: VisitSpec, *, max_waves: int = 4, count_visits: bool = True,
                  bounded: bool = False, **kw) -> DataFrame:
    """All wide features in one aggregation over ranked visits.

    Waves count from the oldest visit; summaries skip NULLs; the slope is over
    the visit index, which counts visits with missing values too.  Pass
    ``bounded=True`` for cohort observations, which have at most ``max_visits``
    rows per entity.  The newest categories are found along the ranking and are keys
    of the aggregation: text in its buffers would make Spark aggregate by sorting.
    """
    refuse_leakage(obs, spec, "wide_features")
    require_columns(obs, [spec.entity, *spec.order], "wide_features")
    used = [c for c in (*spec.numeric, *spec.categorical) if c in obs.columns]
    rows = obs.select(spec.entity, *[F.col(c) for c in spec.order if c not in used], *used)
    rows = rows.withColumns({c: number_or_null(F.col(c)) for c in spec.numeric if c in used})
    newest = {c: f"_newest{k}" for k, c in enumerate(spec.categorical) if c in used}
    ranked = running(rows, [spec.entity], [F.col(c) for c in spec.order], sort_cuts(rows, spec.order),
                     before={"_i": ("count", None)}, group={n: ("last", missing_to_null(F.col(c))) for c, n in newest.items()},
                     bounded=bounded, **kw)
    i = F.col("_i")
    aggs = []
    for c in spec.numeric:
        if c not in used:
            aggs += [F.max(F.lit(None).cast("double")).alias(f"{c}_{s}")
                     for s in [f"w{k}" for k in range(1, max_waves + 1)] + list(SUMMARIES)]
            continue
        v = F.col(c)
        at = F.when(v.isNotNull(), i)
        last, first = F.max_by(v, at), F.min_by(v, at)   # rows with a NULL rank are skipped
        aggs += [F.max(F.when(i == k - 1, v)).alias(f"{c}_w{k}") for k in range(1, max_waves + 1)]
        aggs += [
            last.alias(f"{c}_latest"), F.avg(v).alias(f"{c}_mean"), F.min(v).alias(f"{c}_min"),
            F.max(v).alias(f"{c}_max"), F.stddev_samp(v).alias(f"{c}_std"),
            F.when(F.count(v) >= 2, last - first).alias(f"{c}_delta"),
            F.when(F.count(v) >= 2, F.regr_slope(v, i.cast("double"))).alias(f"{c}_slope")]
    aggs.append(F.count(F.lit(1)).cast("int").alias(COUNT_COLUMN))
    wide = ranked.groupBy(spec.entity, *newest.values()).agg(*aggs)
    numbers = [c for c in wide.columns if c not in (spec.entity, COUNT_COLUMN, *newest.values())]
    latest = [(F.col(newest[c]) if c in newest else F.lit(None).cast("string")).alias(f"{c}_latest") for c in spec.categorical]
    return wide.select(spec.entity, *numbers, *latest, *([COUNT_COLUMN] if count_visits else []))


@dataclass(frozen=True)
class Feature:
    column: str
    source: str
    wave: int | None
    transformation: str
    description: str
    kind: str


def catalogue(spec: VisitSpec, *, max_waves: int = 4, count_visits: bool = True) -> list[Feature]:
    """What every wide column means, in column order."""
    out = []
    for c in spec.numeric:
        out += [Feature(f"{c}_w{k}", c, k, "raw_observation",
                        f"{c} at visit {k}, counted from the oldest",
                        "numeric_wave") for k in range(1, max_waves + 1)]
    for c in spec.numeric:
        out += [Feature(f"{c}_{s}", c, None, name, f"{c}: {text}", "numeric_temporal")
                for s, (name, text) in TRANSFORMATIONS.items()]
    for c in spec.categorical:
        out.append(Feature(f"{c}_latest", c, None, "categorical_latest",
                           f"newest known category of {c}", "categorical"))
    if count_visits:
        out.append(Feature(COUNT_COLUMN, "visit_count", None, "count",
                           "observation visits of the entity", "meta"))
    return out


def catalogue_frame(spark, spec: VisitSpec, **kw) -> DataFrame:
    rows = [(f.column, f.source, f.wave, f.transformation, f.description, f.kind)
            for f in catalogue(spec, **kw)]
    return spark.createDataFrame(
        rows, "feature string, source string, wave int, transformation string, description string, kind string")


def feature_coverage(wide: DataFrame, spec: VisitSpec, **kw) -> DataFrame:
    """The catalogue with the number of entities that have a value for the feature."""
    names = [f.column for f in catalogue(spec, **kw)]
    counts = wide.groupBy().agg(*[F.count(n).alias(n) for n in names])
    long = counts.unpivot([], names, "feature", "n_present")
    return catalogue_frame(wide.sparkSession, spec, **kw).join(long, "feature")


def build_statistics(wide: DataFrame, spec: VisitSpec, *, max_waves: int = 4,
                     count_visits: bool = True) -> DataFrame:
    """One row of counts about a wide table."""
    n_num, n_cat = len(spec.numeric), len(spec.categorical)
    return wide.groupBy().agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.lit(n_num * (max_waves + len(SUMMARIES)) + n_cat + int(count_visits)).alias("n_features"),
        F.lit(n_num * max_waves).alias("n_wave_features"),
        F.lit(n_num * len(SUMMARIES)).alias("n_temporal_features"),
        F.lit(n_cat).alias("n_categorical_features"), F.lit(max_waves).alias("max_waves"))


def attach_targets(features: DataFrame, targets: DataFrame, spec: VisitSpec, *,
                   strict: bool = True) -> DataFrame:
    """Features with their label; with ``strict`` every feature row must have one."""
    if strict:
        missing = features.join(targets, spec.entity, "left_anti").select(spec.entity).limit(5).collect()
        if missing:
            raise DataError(f"no label for entities such as {[r[0] for r in missing]}")
    return features.join(targets.select(spec.entity, spec.target), spec.entity)
