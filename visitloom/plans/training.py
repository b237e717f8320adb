"""From visits to a tested model: cohort, split, features, search, retrain, test once."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cohort import Cohort, future_outcome_cohort
from ..operators.metrics import best_f1_threshold, metric_row
from ..operators.encode import SparseEncoder
from ..operators.preprocess import apply_sequence_stats, fit_sequence_stats
from ..operators.sequence import collect_vocabulary, layout, sequences, vocabulary
from ..operators.guards import strip_leakage
from ..operators.splits import (
    TEST, TRAIN, VALIDATION, check_split, split_statistics, stratified_split, with_split,
)
from ..operators.wide import COUNT_COLUMN, catalogue, catalogue_frame, wide_features
from ..sources.readers import complete_layout
from ..sources.session import written
from ..sources.sinks import write_best_config, write_leaderboard, write_record
from ..spec import CohortRules, DataError, SplitSizes, VisitSpec
from .models import REPRESENTATION, SEQUENCE, WIDE, FittedModel, fit
from .search import SearchResult, Trial, run_search


def wide_columns(spec: VisitSpec, max_waves: int) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of the wide table."""
    feats = catalogue(spec, max_waves=max_waves)
    return ([f.column for f in feats if f.kind != "categorical"],
            [f.column for f in feats if f.kind == "categorical"])


@dataclass
class Artifact:
    """Everything scoring needs: representation, fitted preprocessing, fitted model."""

    spec: VisitSpec
    representation: str
    window: int
    threshold: float
    model: FittedModel
    preprocessor: SparseEncoder | None = None
    vocab: dict[str, list[str]] | None = None
    sequence_stats: DataFrame | None = None

    def features(self, obs: DataFrame, *, bounded: bool = False) -> DataFrame:
        """``entity, n_visits, features`` for any visits; absent columns count as missing."""
        obs = complete_layout(obs, self.spec)
        e = self.spec.entity
        if self.representation == WIDE:
            return self.features_of(wide_features(obs, self.spec, max_waves=self.window, bounded=bounded))
        counts = obs.groupBy(e).agg(F.count(F.lit(1)).cast("int").alias("n_visits"))
        seq = sequences(obs, self.spec, self.vocab, self.window)
        names = layout(obs, self.spec, self.vocab)
        return flatten(apply_sequence_stats(seq, self.sequence_stats, names), e, ["mask"]).join(counts, e)

    def features_of(self, table: DataFrame) -> DataFrame:
        """The same from a table of :meth:`Prepared.table`: wide rows, or cohort observations."""
        if self.representation == SEQUENCE:
            return self.features(table, bounded=True)
        keep = [self.spec.entity, "n_visits"]
        return self.preprocessor.vectors(table.withColumn("n_visits", F.col(COUNT_COLUMN).cast("int")), keep)

    def score(self, obs: DataFrame, *, bounded: bool = False) -> DataFrame:
        """``entity, n_visits, p, prediction``."""
        scored = self.model.predict(self.features(obs, bounded=bounded), self.threshold)
        return scored.select(self.spec.entity, "n_visits", "p", "prediction")

    def save(self, spark: SparkSession, folder: str) -> None:
        self.model.save(f"{folder}/model")
        if self.preprocessor:
            self.preprocessor.write(spark, f"{folder}/preprocessor")
        if self.sequence_stats is not None:
            self.sequence_stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sequence_stats")
        meta = {"representation": self.representation, "window": self.window, "threshold": self.threshold,
                "family": self.model.family, "params": self.model.params, "vocab": self.vocab}
        (spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{folder}/metadata"))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, spec: VisitSpec) -> "Artifact":
        meta = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
        wide = meta["representation"] == WIDE
        return cls(
            spec, meta["representation"], meta["window"], meta["threshold"],
            FittedModel.load(f"{folder}/model", meta["family"], meta["params"]),
            SparseEncoder.read(spark, f"{folder}/preprocessor") if wide else None, meta["vocab"],
            None if wide else spark.read.parquet(f"{folder}/sequence_stats"))


def flatten(packed: DataFrame, entity: str, extra: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Padded sequences as one vector: all steps, then the mask."""
    from pyspark.ml.functions import array_to_vector
    parts = [F.flatten("X")] + [F.col(c).cast("array<double>") for c in extra]
    return packed.select(entity, *keep, array_to_vector(F.concat(*parts)).alias("features"))


@dataclass
class Prepared:
    """A split cohort as written tables."""

    spec: VisitSpec
    window: int
    observations: DataFrame        # observation rows and their split
    targets: DataFrame             # entity, target, split
    wide: DataFrame | None         # wide rows and their split

    def table(self, representation: str, *splits: str) -> DataFrame:
        """What a representation is fitted on: wide rows or observations, of the given splits (or all)."""
        rows = self.wide if representation == WIDE else self.observations
        return (rows.filter(F.col("split").isin(*splits)) if splits else rows).drop("split")


def prepare(cohort: Cohort, sizes: SplitSizes = SplitSizes(), *, seed: int = 42,
            representations: tuple[str, ...] = (WIDE, SEQUENCE)) -> Prepared:
    """Split a cohort and write what the fits will read many times.

    Written tables cut the lineage and outlive lost executors.
    """
    spec, window = cohort.spec, cohort.rules.max_visits
    cohort = cohort.with_written_audit()
    # Every eligible entity has observation rows, so the audit is the candidate list.
    split = written(stratified_split(cohort.targets, spec, sizes, seed=seed), "split")
    rows = complete_layout(with_split(strip_leakage(cohort.observed, spec), split, spec), spec)
    rows = written(rows, "observations", "split")
    wide = None
    if WIDE in representations:
        built = wide_features(rows.drop("split"), spec, max_waves=window, bounded=True)
        wide = written(with_split(built, split, spec), "wide", "split")
    return Prepared(spec, window, rows, split, wide)


def fit_representation(table: DataFrame, spec: VisitSpec, representation: str, window: int,
                       threshold: float = 0.5) -> Artifact:
    """Fit preprocessing on training rows of :meth:`Prepared.table`; the model comes later."""
    shell = Artifact(spec, representation, window, threshold, model=None)
    if representation == WIDE:
        return replace(shell, preprocessor=SparseEncoder.fit(table, *wide_columns(spec, window)))
    vocab = collect_vocabulary(vocabulary(table, spec))
    seq = sequences(table, spec, vocab, window)
    return replace(shell, vocab=vocab, sequence_stats=fit_sequence_stats(seq, spec, layout(table, spec, vocab)))


def labelled(artifact: Artifact, table: DataFrame, targets: DataFrame) -> DataFrame:
    """``entity, features, label``; labels are joined by entity."""
    e = artifact.spec.entity
    label = targets.select(e, F.col(artifact.spec.target).cast("double").alias("label"))
    return artifact.features_of(table).select(e, "features").join(label, e)


@dataclass
class TrainingResult:
    cohort: Cohort
    prepared: Prepared
    search: SearchResult
    artifact: Artifact           # retrained on train and validation
    validation_metrics: dict
    test_metrics: DataFrame

    def save(self, spark: SparkSession, folder: str) -> None:
        self.artifact.save(spark, f"{folder}/artifact")
        write_leaderboard(self.search.leaderboard, f"{folder}/leaderboard")
        write_best_config(self.search.leaderboard, f"{folder}/best_config")
        write_record(self.test_metrics, f"{folder}/test_metrics")
        write_record(self.cohort.counts(), f"{folder}/cohort_counts")
        write_record(split_statistics(self.prepared.targets, self.artifact.spec), f"{folder}/split_statistics")
        write_record(spark.createDataFrame([(k, float(v)) for k, v in self.validation_metrics.items()
                                            if v is not None], "metric string, value double"),
                     f"{folder}/validation_metrics")
        if self.artifact.representation == WIDE:
            write_record(catalogue_frame(spark, self.artifact.spec, max_waves=self.artifact.window),
                         f"{folder}/feature_catalogue")


def train(spark: SparkSession, visits: DataFrame | None, spec: VisitSpec, trials: list[Trial], *,
          rules: CohortRules = CohortRules(), sizes: SplitSizes = SplitSizes(), seed: int = 42,
          threshold: float | None = 0.5, parallelism: int = 2, cohort: Cohort | None = None) -> TrainingResult:
    """The whole run.  Validation data choose the trial, test data are read once at the end.

    With ``threshold=None`` the best trial's F1 on validation chooses the threshold too.
    """
    tuned, threshold = threshold is None, 0.5 if threshold is None else threshold
    if cohort is None:      # the visits are read for the cutoffs, the outcomes and the observations
        cohort = future_outcome_cohort(written(visits, "visits"), spec, rules)
    wanted = tuple(sorted({t.representation for t in trials}))
    ready = prepare(cohort, sizes, seed=seed, representations=wanted)
    targets = ready.targets
    check_split(targets, spec)

    data = {}
    for representation in wanted:
        shell = fit_representation(ready.table(representation, TRAIN), spec, representation, ready.window, threshold)
        data[representation] = tuple(
            labelled(shell, ready.table(representation, s), targets).persist() for s in (TRAIN, VALIDATION))
    try:
        found = run_search(spark, trials, data, threshold=threshold, parallelism=parallelism)
        if tuned:
            val = found.models[found.best.number].predict_proba(data[found.best.representation][1])
            best = best_f1_threshold(val, y="label").first()["threshold"]   # one row
            threshold = threshold if best is None else best
    finally:
        for pair in data.values():
            for df in pair:
                df.unpersist()

    chosen = found.best.representation
    both = ready.table(chosen, TRAIN, VALIDATION)
    final = fit_representation(both, spec, chosen, ready.window, threshold)
    final = replace(final, model=fit(found.best.family, dict(found.best.params), labelled(final, both, targets)))
    scored = final.model.predict_proba(labelled(final, ready.table(chosen, TEST), targets))
    return TrainingResult(cohort, ready, found, final, found.best_metrics,
                          metric_row(scored, threshold, y="label", prefix="test_"))


def chosen_representation(family: str) -> str:
    if family not in REPRESENTATION:
        raise DataError(f"unknown model family {family!r}")
    return REPRESENTATION[family]


__all__ = ["Artifact", "Prepared", "SEQUENCE", "TrainingResult", "WIDE", "fit_representation", "flatten",
           "labelled", "prepare", "train"]
