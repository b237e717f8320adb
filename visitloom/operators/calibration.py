"""Reliability bins and calibration errors of predicted probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..spec import DataError


def check_predictions(df: DataFrame, y: str = "y", p: str = "p") -> None:
    """Raise unless labels are 0/1, probabilities lie in [0, 1] and there are rows."""
    label, prob = F.col(y), F.col(p).cast("double")
    r = df.groupBy().agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("labels"),
        F.count_if(prob.isNull() | F.isnan(prob)).alias("undefined"),
        F.count_if((prob < 0) | (prob > 1)).alias("range")).first()
    if r["rows"] == 0:
        raise DataError("no predictions")
    problems = {k: r[k] for k in ("labels", "undefined", "range") if r[k]}
    if problems:
        raise DataError(f"invalid predictions: {problems}")


def reliability_bins(df: DataFrame, n_bins: int = 10, by: Sequence[str] = (), y: str = "y",
                     p: str = "p") -> DataFrame:
    """One row per equal-width bin, empty bins included; 1.0 belongs to the last bin."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    index = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1))).cast("int")
    per = df.groupBy(*by, index.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y"))
    rows = F.collect_list(F.struct("_b", "_n", "_p", "_y"))   # at most n_bins items
    filled = per.groupBy(*by).agg(F.map_from_entries(F.transform(
        rows, lambda r: F.struct(r["_b"], r))).alias("_m"))
    slots = filled.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    found = F.try_element_at("_m", F.col("bin"))
    return slots.select(
        *by, "bin", (F.col("bin") / F.lit(float(n_bins))).alias("lower"),
        ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("upper"),
        F.coalesce(found["_n"], F.lit(0)).cast("long").alias("count"),
        found["_p"].alias("mean_predicted"), found["_y"].alias("observed_frequency"))


def calibration_report(df: DataFrame, n_bins: int = 10, by: Sequence[str] = (), y: str = "y",
                       p: str = "p") -> DataFrame:
    """ECE, MCE, and the bin behind the MCE (lowest on ties) with its support."""
    gap = F.abs(F.col("observed_frequency") - F.col("mean_predicted"))
    bins = reliability_bins(df, n_bins, by, y, p).withColumn("_gap", gap)
    worst = F.max(F.when(F.col("count") > 0, F.struct(
        F.col("_gap"), (-F.col("bin")).alias("neg"), F.col("count"))))
    out = bins.groupBy(*by).agg(
        F.sum("count").alias("n_samples"), F.sum(F.col("count") * F.col("_gap")).alias("_s"),
        worst.alias("_w"))
    return out.select(
        *by, F.lit(n_bins).alias("n_bins"), "n_samples", (F.col("_s") / F.col("n_samples")).alias("ece"),
        F.col("_w._gap").alias("mce"), (-F.col("_w.neg")).alias("mce_bin"),
        F.col("_w.count").alias("mce_bin_count"))
