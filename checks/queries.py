"""One query per operator, each over whole tables.

Results are rounded and dates written as text so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitloom.functions import as_flag, missing_to_null
from visitloom.operators import (
    calibration, cohort as co, guards, metrics as me, perturb as pe, preprocess as pp, profile as pr,
    quality as qu, sequence as se, splits as sp, stability as st, visit_table as vt, wide as wi,
)
from visitloom.operators.encode import SparseEncoder
from visitloom.operators.names import readable_names
from visitloom.plans import explain as ex, models as mo, search as sr, training as tr
from visitloom.plans.robustness import robustness_sweep
from visitloom.plans.selection import score_selection
from visitloom.sources import readers, sinks
from visitloom.sources.run_store import publish_run, read_run
from visitloom.sources.session import shared_folder, tune, written
from visitloom.sources.visit_store import VisitStore
from visitloom.spec import CohortRules, Condition

from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
S, N = t.SPEC, t.NARROW
LENIENT = CohortRules(inconsistent_is_error=False)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(tune(spark), sf)
    QUERIES[fn.__name__] = run
    return fn


def texts(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if d == "double" else F.col(f"`{c}`")
                       for c, d in df.dtypes])


# --- visits and cohorts --------------------------------------------------

@query
def visits(spark, sf):
    return rounded(texts(t.visits(spark, sf, segment=True), "visit_date"))


def positional(spark, sf):
    return co.future_outcome_cohort(t.visits(spark, sf), N)


def stored_visits(spark, sf):
    """The visits as a table, for queries that read them several times."""
    return written(t.visits(spark, sf), "visits")


def flagged(spark, sf):
    return co.future_outcome_cohort(t.timeline(spark, sf), N)


@query
def cohort_outcome(spark, sf):
    return positional(spark, sf).status


@query
def cohort_status_counts(spark, sf):
    return positional(spark, sf).counts()


@query
def cohort_audit(spark, sf):
    return rounded(texts(positional(spark, sf).audit, "cutoff", "horizon_end"))


@query
def cohort_observation(spark, sf):
    return rounded(texts(positional(spark, sf).observations, "visit_date"))


@query
def cohort_flagged_outcome(spark, sf):
    return flagged(spark, sf).status


@query
def cohort_flagged_audit(spark, sf):
    return rounded(texts(flagged(spark, sf).audit, "cutoff", "horizon_end"))


@query
def cohort_flagged_observation(spark, sf):
    return rounded(texts(flagged(spark, sf).observations, "visit_date"))


@query
def cohort_leaked_rows(spark, sf):
    c = flagged(spark, sf)
    bad = co.visits_after_cutoff(c.observations, c.audit, N)
    return bad.groupBy().agg(F.count(F.lit(1)).alias("n_leaked"))


@query
def cohort_prelabeled(spark, sf):
    return co.prelabeled_cohort(t.labelled_visits(spark, sf), N).status


@query
def cohort_prelabeled_audit(spark, sf):
    return texts(co.prelabeled_cohort(t.labelled_visits(spark, sf), N).audit, "cutoff")


@query
def cohort_prelabeled_observation(spark, sf):
    return rounded(texts(co.prelabeled_cohort(t.labelled_visits(spark, sf), N).observations, "visit_date"))


@query
def cohort_inconsistent_counts(spark, sf):
    return co.prelabeled_cohort(t.labelled_visits(spark, sf, consistent=False), N, LENIENT).counts()


# --- projections and guards ----------------------------------------------

def leaky(spark, sf):
    return t.timeline(spark, sf).select(
        "entity_id", "visit_id", "amount", "is_future_visit", F.col("event_flag").alias("outcome"),
        F.col("quantity").alias("Future_HbA1c_max"), F.col("status").alias("note"))


@query
def strip_leakage(spark, sf):
    return guards.strip_leakage(leaky(spark, sf), S)


@query
def safe_columns(spark, sf):
    return guards.select_safe(leaky(spark, sf), S)


@query
def observation_rows(spark, sf):
    return rounded(texts(sinks.observation_rows(t.timeline(spark, sf), S), "visit_date"))


def untidy(spark, sf):
    """Order fields written in the spellings that ingestion has to read."""
    o = t.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    note = (F.when(k % 6 == 0, " NaN ").when(k % 6 == 1, "None").when(k % 6 == 2, "<NA>")
            .when(k % 6 == 3, "").when(k % 6 == 4, F.concat(F.lit(" "), F.col("o_orderpriority")))
            .otherwise(None))
    flag = (F.when(k % 5 == 0, " True").when(k % 5 == 1, "0").when(k % 5 == 2, "1").when(k % 5 == 3, "maybe"))
    return o.select(k.alias("visit_id"), F.concat(F.lit("  C"), F.col("o_custkey"), F.lit(" ")).alias("entity_id"),
                    F.col("o_orderdate").cast("date").alias("visit_date"), note.alias("status"),
                    flag.alias("flag"), F.col("o_totalprice").alias("amount"), F.lit("x").alias("other"))


@query
def missing_tokens(spark, sf):
    return untidy(spark, sf).select("visit_id", missing_to_null(F.col("status")).alias("status"))


@query
def future_flags(spark, sf):
    rows = untidy(spark, sf)
    return rows.select("visit_id", as_flag(rows, "flag").cast("int").alias("is_future"))


@query
def clean_clinical(spark, sf):
    return rounded(texts(vt.clean_clinical(untidy(spark, sf), S), "visit_date"))


@query
def normalized_ids(spark, sf):
    return vt.normalized_ids(untidy(spark, sf).select("visit_id", "entity_id"), S)


# --- wide features ---------------------------------------------------------

def wide_all(spark, sf, segment=False):
    return wi.wide_features(t.visits(spark, sf, segment=segment), S if segment else N)


def pick(df, *suffixes, extra=()):
    names = [c for c in df.columns if c.rsplit("_", 1)[-1] in suffixes]
    return rounded(df.select("entity_id", *names, *extra))


@query
def wide_waves(spark, sf):
    return pick(wide_all(spark, sf), "w1", "w2", "w3", "w4", extra=("n_obs_visits",))


@query
def wide_temporal(spark, sf):
    return pick(wide_all(spark, sf).drop("status_latest", "priority_latest"),
                "latest", "mean", "min", "max", "std", "delta")


@query
def wide_slope(spark, sf):
    return pick(wide_all(spark, sf), "slope")


@query
def wide_categorical(spark, sf):
    return wide_all(spark, sf, segment=True).select(
        "entity_id", "status_latest", "priority_latest", "segment_latest")


def wide_cohort(spark, sf):
    c = positional(spark, sf)
    return wi.wide_features(c.observations, N, bounded=True), c


@query
def wide_cohort_features(spark, sf):
    return rounded(wide_cohort(spark, sf)[0])


@query
def feature_catalogue(spark, sf):
    return wi.feature_coverage(wide_all(spark, sf), N).drop("description")


@query
def wide_statistics(spark, sf):
    return wi.build_statistics(wide_all(spark, sf), N)


@query
def wide_labelled(spark, sf):
    w, c = wide_cohort(spark, sf)
    return rounded(wi.attach_targets(w.select("entity_id", "amount_latest"), c.targets, N))


# --- sequences -------------------------------------------------------------

def vocab_of(spark, sf, rows=None):
    return se.collect_vocabulary(se.vocabulary(rows if rows is not None else t.visits(spark, sf), N))


@query
def seq_vocabulary(spark, sf):
    return se.vocabulary(t.visits(spark, sf, segment=True), S)


@query
def seq_feature_names(spark, sf):
    v = t.visits(spark, sf)
    names = se.layout(v, N, vocab_of(spark, sf))
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def packed(spark, sf):
    v = t.visits(spark, sf)
    vocab = vocab_of(spark, sf)
    return se.sequences(v, N, vocab), se.layout(v, N, vocab)


@query
def seq_long(spark, sf):
    x, names = packed(spark, sf)
    return rounded(se.unpack(x, N, names).filter("is_real = 1").drop("is_real"))


@query
def seq_mask_lengths(spark, sf):
    x, _ = packed(spark, sf)
    return x.select("entity_id", "length", F.posexplode("mask").alias("step", "mask"))


@query
def seq_padding(spark, sf):
    x, names = packed(spark, sf)
    pad = se.unpack(x, N, names).filter("is_real = 0")
    return pad.groupBy("entity_id").agg(F.count("value").alias("n_cells"), F.sum(F.abs("value")).alias("total"))


@query
def seq_length_stats(spark, sf):
    return rounded(se.length_statistics(packed(spark, sf)[0]))


@query
def seq_unseen_labels(spark, sf):
    v = t.visits(spark, sf)
    vocab = vocab_of(spark, sf, v.filter("status <> 'P'"))
    x = se.sequences(v, N, vocab)
    long = se.unpack(x, N, se.layout(v, N, vocab)).filter("is_real = 1 AND feature LIKE 'status%'")
    return long.select("entity_id", "step", "feature", F.col("value").cast("int").alias("value"))


# --- splits ------------------------------------------------------------------

def targets(spark, sf):
    return t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), (F.col("c_acctbal") < 0).cast("int").alias("target"))


def observed_targets(spark, sf):
    o = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("date").alias("visit_date"))
    return o, sp.candidates(o, targets(spark, sf), N)


@query
def split_candidates(spark, sf):
    return observed_targets(spark, sf)[1]


@query
def split_stratified(spark, sf):
    return sp.stratified_split(observed_targets(spark, sf)[1], N)


@query
def split_plain(spark, sf):
    return sp.stratified_split(observed_targets(spark, sf)[1], N, stratify=False)


@query
def split_chronological(spark, sf):
    o, labeled = observed_targets(spark, sf)
    return sp.chronological_split(o, labeled, N)


@query
def split_internal(spark, sf):
    return sp.internal_split(observed_targets(spark, sf)[1], N, 0.2)


@query
def split_stats(spark, sf):
    return sp.split_statistics(sp.stratified_split(observed_targets(spark, sf)[1], N), N)


@query
def split_overlap(spark, sf):
    s = sp.stratified_split(observed_targets(spark, sf)[1], N)
    return sp.overlapping_entities(s, N).groupBy().agg(F.count(F.lit(1)).alias("n_overlap"))


@query
def split_rows(spark, sf):
    o, labeled = observed_targets(spark, sf)
    rows = sp.with_split(o, sp.stratified_split(labeled, N), N)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_distinct("entity_id").alias("n_entities"))


# --- preprocessing -------------------------------------------------------------

@query
def fit_numeric(spark, sf):
    w = wide_all(spark, sf)
    names = [c for c, d in w.dtypes if c != "entity_id" and d != "string"]
    return rounded(pp.fit_numeric(w, names))


@query
def fit_categories(spark, sf):
    return pp.fit_categories(wide_all(spark, sf, segment=True),
                             ["status_latest", "priority_latest", "segment_latest"])


@query
def transform_wide(spark, sf):
    """Fitted on entities of the training split, applied to all."""
    w = wide_all(spark, sf).select("entity_id", "amount_latest", "discount_std", "quantity_w4",
                                   "status_latest", "n_obs_visits")
    split = sp.stratified_split(observed_targets(spark, sf)[1], N).filter("split = 'train'")
    train = w.join(split.select("entity_id"), "entity_id", "left_semi")
    p = pp.Preprocessor.fit(train, ["amount_latest", "discount_std", "quantity_w4", "n_obs_visits"],
                            ["status_latest"])
    return rounded(p.transform(w, ["entity_id"]))


@query
def transform_wide_full(spark, sf):
    """All wide columns as sparse vectors, fitted on entities of the training split; entries that are not 0."""
    w = written(wi.wide_features(stored_visits(spark, sf), N), "wide")
    numeric = [c for c, d in w.dtypes if c != "entity_id" and d != "string"]
    split = sp.stratified_split(observed_targets(spark, sf)[1], N).filter("split = 'train'")
    train = w.join(split.select("entity_id"), "entity_id", "left_semi")
    encoder = SparseEncoder.fit(train, numeric, ["status_latest", "priority_latest"])
    return rounded(encoder.cells(encoder.vectors(w, ["entity_id"]), ["entity_id"])).filter("value <> 0")


@query
def seq_fit_stats(spark, sf):
    x, names = packed(spark, sf)
    return rounded(pp.fit_sequence_stats(x, N, names))


@query
def transform_seq(spark, sf):
    x, names = packed(spark, sf)
    done = pp.apply_sequence_stats(x, pp.fit_sequence_stats(x, N, names), names)
    return rounded(se.unpack(done, N, names).filter("feature IN ('amount', 'quantity', 'n_lines', 'discount')"))


@query
def transform_seq_full(spark, sf):
    """Every slot of the real steps, numbers imputed and scaled, with the vocabulary left as a table."""
    v = t.visits(spark, sf)
    x, names = se.sequences(v, N, se.vocabulary(v, N)), se.layout(v, N, vocab_of(spark, sf, v))
    done = pp.apply_sequence_stats(x, pp.fit_sequence_stats(x, N, names), names)
    return rounded(se.unpack(done, N, names).filter("is_real = 1").drop("is_real"))


# --- metrics ---------------------------------------------------------------------

@query
def roc_points(spark, sf):
    return rounded(me.roc_points(t.predictions(spark, sf)))


@query
def auroc(spark, sf):
    return rounded(me.auroc(t.predictions(spark, sf)))


@query
def auroc_by_source(spark, sf):
    return rounded(me.auroc(t.predictions(spark, sf), ["source"]))


@query
def pr_points(spark, sf):
    return rounded(me.pr_points(t.predictions(spark, sf)))


@query
def auprc(spark, sf):
    return rounded(me.auprc(t.predictions(spark, sf)))


@query
def confusion(spark, sf):
    return me.confusion(t.predictions(spark, sf), 0.3, ["lang"])


@query
def threshold_rates(spark, sf):
    return rounded(me.threshold_rates(t.predictions(spark, sf), 0.3, ["source"]))


@query
def brier(spark, sf):
    return rounded(me.brier(t.predictions(spark, sf), ["lang"]))


@query
def metric_row(spark, sf):
    return rounded(me.metric_row(t.predictions(spark, sf), 0.3, ["lang"], prefix="val_"))


@query
def f1_by_threshold(spark, sf):
    return rounded(me.f1_by_threshold(t.predictions(spark, sf)))


@query
def threshold_f1(spark, sf):
    return rounded(me.best_f1_threshold(t.predictions(spark, sf), by=["lang"]))


@query
def reliability_bins(spark, sf):
    p = t.predictions(spark, sf)
    calibration.check_predictions(p)
    return rounded(calibration.reliability_bins(p))


@query
def reliability_bins_by_source(spark, sf):
    return rounded(calibration.reliability_bins(t.predictions(spark, sf), 5, ["source"]))


@query
def calibration_report(spark, sf):
    return rounded(calibration.calibration_report(t.predictions(spark, sf), 10, ["lang"]))


@query
def class_weights(spark, sf):
    labeled = observed_targets(spark, sf)[1].withColumnRenamed("target", "label")
    return rounded(mo.balanced_weights(labeled).groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n")))


@query
def run_records(spark, sf):
    """A validated run record per language, written, read back and flattened."""
    row = me.metric_row(t.predictions(spark, sf), 0.3, ["lang"])
    runs = sinks.metrics_map(row, ["lang"]).select(
        F.lit(sinks.RUN_SCHEMA_VERSION).alias("schema_version"), F.concat(F.lit("run_"), "lang").alias("run_id"),
        F.lit(None).cast("string").alias("config_hash"), F.create_map(F.lit("split"), F.lit(42).cast("long"))
        .alias("seeds"), F.lit("documents").alias("dataset_id"), F.lit(None).cast("string").alias("split_id"),
        F.struct(F.lit("baseline").alias("kind"), F.lit(None).cast("double").alias("strength"),
                 F.create_map().cast("map<string,string>").alias("params")).alias("condition"),
        "metrics", F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit("2024-01-01T00:00:00Z").alias("created_utc"))
    path = shared_folder(spark, "runs")
    sinks.append_runs(runs, path)
    return rounded(sinks.read_runs(spark, path).select("run_id", F.explode("metrics").alias("metric", "value")))


@query
def run_round_trip(spark, sf):
    """The timeline and its observations published as one run and read back: rows by manifest and by status."""
    line = t.timeline(spark, sf)
    folder = shared_folder(spark, "published")
    listed = publish_run({"timeline": line, "observations": sinks.observation_rows(line, S)}, folder, "run_1")
    rows = None
    for part, df in read_run(spark, folder, "run_1").items():
        some = df.groupBy(F.lit(part).alias("part"), "status").agg(
            F.count(F.lit(1)).alias("n_visits"), F.max("amount").alias("highest"), F.sum("n_lines").alias("n_lines"),
            F.max("visit_date").cast("string").alias("latest"))
        rows = some if rows is None else rows.unionByName(some)
    return rounded(rows.join(listed.select("part", "n_rows"), "part"))   # the manifest has two rows


# --- explanation stability ---------------------------------------------------------

@query
def stability_top_k(spark, sf):
    return st.top_k(t.part_scores(spark, sf)[0], 20)


@query
def topk_jaccard(spark, sf):
    return rounded(st.topk_jaccard(*t.part_scores(spark, sf), 50))


@query
def average_ranks(spark, sf):
    return st.average_ranks(t.part_scores(spark, sf)[0], "score", "rank")


@query
def spearman(spark, sf):
    return rounded(st.spearman(*t.part_scores(spark, sf)))


@query
def stability_report(spark, sf):
    return rounded(st.stability_report(*t.part_scores(spark, sf), k=25))


@query
def ranking_scores(spark, sf):
    return st.scores_from_ranking(t.part_scores(spark, sf)[0], "key", "score")


# --- sources, validation and profiles --------------------------------------------------

@query
def load_csv(spark, sf):
    """Visits written as CSV with untidy names, read back and typed."""
    path = shared_folder(spark, "csv")
    v = t.visits(spark, sf)
    v = v.withColumn("amount", F.when(F.col("n_lines").isNull(), "n/a").otherwise(F.col("amount").cast("string")))
    v.toDF(*[f" {c.upper()} " for c in v.columns]).write.csv(path, header=True)
    return rounded(texts(readers.read_visits_csv(spark, path, N), "visit_date"))


@query
def trajectories_json(spark, sf):
    """Visits nested as JSON, at most 50 to a document, written, parsed and typed."""
    v = t.visits(spark, sf)
    numbered = vt.visit_history(v, v.select("entity_id").distinct(), N)
    visit = F.struct("visit_date", "visit_id", "visit_number", "amount", "quantity", "status")
    docs = (numbered.withColumn("_doc", F.floor((F.col("visit_number") - 1) / 50))
            .groupBy("entity_id", "_doc").agg(F.collect_list(visit).alias("visits"))
            .select(F.to_json(F.struct("entity_id", "visits")).alias("value")))
    path = shared_folder(spark, "trajectories")
    docs.write.text(path)
    read = readers.read_trajectories(spark, path, N, lines=True)
    return rounded(texts(read.select("entity_id", "visit_id", "visit_date", "visit_number", "amount", "quantity",
                                     "n_lines", "status", "priority"), "visit_date"))


def spoiled_csv(spark, sf):
    """Orders as CSV lines of which some lack an id, have a date that is none, a word for a number or a field too many."""
    path, k = shared_folder(spark, "csv"), F.col("o_orderkey")
    rows = t.table(spark, sf, "orders").select(
        k.cast("string").alias("VISIT_ID"), F.when(k % 17 == 0, " nan ").otherwise(F.col("o_custkey").cast("string")).alias(" Entity_ID "),
        F.when(k % 19 == 0, "31/31/1999").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("visit_date"),
        F.when(k % 13 == 0, "much").when(k % 29 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(k % 23 == 0, "F,more").otherwise(F.col("o_orderstatus")).alias("status"))
    rows.write.option("quote", "").csv(path, header=True)
    return path


@query
def load_csv_rejects(spark, sf):
    """Refused lines with every reason, by visit id."""
    found = readers.read_csv_with_rejects(spark, spoiled_csv(spark, sf), N, numbers=True).rejects
    visit = F.regexp_extract("record", r'^"?([0-9]+)', 1).cast("long")
    return found.select(visit.alias("visit_id"), F.array_join("reasons", ",").alias("reasons"))


@query
def load_csv_accepted(spark, sf):
    """The typed rows of the other lines; words for numbers become NULL."""
    rows = readers.read_csv_with_rejects(spark, spoiled_csv(spark, sf), N).rows
    return rounded(texts(rows, "visit_date"))


def spoiled_documents(spark, sf):
    """A JSON document per entity; some are cut short, lack dates or an id, or name a future column."""
    v, e = t.visits(spark, sf), F.col("entity_id")
    day = F.when((e % 7 == 0) & (F.col("visit_id") % 2 == 0), "soon").otherwise(F.col("visit_date").cast("string"))
    visit = F.struct(day.alias("visit_date"), "visit_id", "amount", "status")
    late = F.struct(day.alias("visit_date"), "visit_id", "amount", "status", F.lit(None).cast("int").alias("target"))
    docs = v.groupBy("entity_id").agg(F.collect_list(visit).alias("visits"), F.collect_list(late).alias("late"))
    own = {"ignoreNullFields": "false"}
    body = F.when(e % 11 == 0, F.to_json(F.struct("entity_id", F.col("late").alias("visits")), own)).when(
        e % 13 == 0, F.to_json(F.struct("visits"), own)).otherwise(F.to_json(F.struct("entity_id", "visits"), own))
    return docs.select("entity_id", F.when(e % 17 == 0, F.substring(body, 1, 30)).otherwise(body).alias("value"))


@query
def trajectory_rejects(spark, sf):
    """Refused documents by entity, with every reason."""
    found = readers.split_trajectories(spoiled_documents(spark, sf), "value", N, keep=("entity_id",)).rejects
    return found.select("entity_id", F.array_join("reasons", ",").alias("reasons"))


@query
def trajectories_accepted(spark, sf):
    """Visits of the other documents."""
    rows = readers.split_trajectories(spoiled_documents(spark, sf), "value", N).rows
    return rounded(texts(rows.select("entity_id", "visit_id", "visit_date", "amount", "status"), "visit_date"))


def checked(spark, sf):
    """Visits with a target that varies and a yes/no column with other values."""
    v = t.labelled_visits(spark, sf, consistent=False)
    bulk = F.when(F.col("n_lines") >= 7, "YES").when(F.col("n_lines") >= 3, "no").when(
        F.col("n_lines") >= 1, "few")
    return v.withColumn("bulk", bulk).withColumn(
        "target", F.when(F.col("status") == "P", 2).otherwise(F.col("target")))


@query
def findings(spark, sf):
    return qu.findings(checked(spark, sf), S, expected=("amount", "height", "weight"), ordinal="visit_id")


def untidy_checked(spark, sf):
    """The same with empty ids, dates that are none and the name of a future column."""
    v = F.col("visit_id")
    return checked(spark, sf).withColumns({
        "entity_id": F.when(v % 37 == 0, " NaN ").otherwise(F.col("entity_id").cast("string")),
        "visit_date": F.when(v % 41 == 0, "no date").otherwise(F.col("visit_date").cast("string")),
        "outcome_later": F.lit(1)})


@query
def findings_untidy(spark, sf):
    return qu.findings(untidy_checked(spark, sf), S, expected=("amount", "height"), ordinal="visit_id",
                       allow_duplicates=True, target_is_error=False)


@query
def findings_missing_columns(spark, sf):
    return qu.findings(checked(spark, sf).drop("visit_date"), S, ordinal="visit_id")


@query
def duplicate_visits(spark, sf):
    return texts(qu.duplicate_groups(t.visits(spark, sf), N), "visit_date")


@query
def unordered_entities(spark, sf):
    return qu.unordered_entities(t.visits(spark, sf), N, "visit_id")


@query
def inconsistent_targets(spark, sf):
    return qu.inconsistent_targets(checked(spark, sf), N)


@query
def invalid_yes_no(spark, sf):
    return qu.invalid_yes_no(checked(spark, sf), N)


@query
def invalid_targets(spark, sf):
    return qu.invalid_targets(checked(spark, sf), N)


@query
def profile_counts(spark, sf):
    return texts(pr.dataset_counts(t.visits(spark, sf), N), "date_min", "date_max")


@query
def profile_numeric(spark, sf):
    return pr.numeric_summary(t.visits(spark, sf), N)


@query
def profile_categorical(spark, sf):
    return pr.categorical_summary(untidy(spark, sf), N)


@query
def category_counts(spark, sf):
    return pr.category_counts(untidy(spark, sf), N)


@query
def missingness(spark, sf):
    return pr.missingness(t.visits(spark, sf))


@query
def target_distribution(spark, sf):
    return pr.target_distribution(t.labelled_visits(spark, sf, consistent=False), N, ["visit_id"])


@query
def dataset_metadata(spark, sf):
    return pr.dataset_metadata(t.labelled_visits(spark, sf), N)


@query
def duplicate_count(spark, sf):
    return pr.duplicate_count(t.visits(spark, sf), N)


@query
def visits_per_entity(spark, sf):
    return pr.visits_per_entity(t.visits(spark, sf), N)


# --- perturbations ------------------------------------------------------------------------

@query
def remove_measurements(spark, sf):
    return rounded(texts(pe.remove_measurements(t.visits(spark, sf), N, 0.3), "visit_date"))


@query
def blanked_cells(spark, sf):
    return pe.blanked_cells(t.visits(spark, sf), N, 0.3)


@query
def remove_visits(spark, sf):
    return texts(pe.remove_visits(t.visits(spark, sf), N, 0.4, min_visits_kept=2)
                 .select("entity_id", "visit_id", "visit_date"), "visit_date")


@query
def truncate_recent(spark, sf):
    return texts(pe.truncate_to_recent_visits(t.visits(spark, sf), N, 3)
                 .select("entity_id", "visit_id", "visit_date"), "visit_date")


@query
def jitter_timing(spark, sf):
    return texts(pe.jitter_visit_timing(t.visits(spark, sf), N, 30)
                 .select("entity_id", "visit_id", "visit_date"), "visit_date")


@query
def perturbation_summary(spark, sf):
    v = t.visits(spark, sf)
    c = Condition("remove_visits", 0.4, {"seed": 42, "min_visits_kept": 2})
    record = pe.condition_record(v, pe.remove_visits(v, N, 0.4, min_visits_kept=2), N, c)
    return record.withColumn("params", F.array_join(F.array_sort(F.transform(
        F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"))


# --- the visit table -------------------------------------------------------------------------

@query
def register_patients(spark, sf):
    """Every fifth customer key is known; all order customers arrive, some with spaces."""
    known = t.table(spark, sf, "customer").filter(F.col("c_custkey") % 5 == 0).select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("C"), "c_custkey").alias("entity_id"))
    return vt.register_patients(known, untidy(spark, sf), N)


@query
def visit_history(spark, sf):
    v = t.visits(spark, sf).select("entity_id", "visit_id", "visit_date", "amount")
    patients = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return rounded(texts(vt.visit_history(v, patients, N), "visit_date"))


def changes(spark, sf):
    v = t.visits(spark, sf).select("entity_id", "visit_id", "visit_date", "amount", "status", "priority")
    return vt.apply_changes(v, t.change_log(spark, sf), N)


@query
def apply_visit_changes(spark, sf):
    return rounded(texts(changes(spark, sf).visits, "visit_date"))


@query
def rejected_changes(spark, sf):
    return changes(spark, sf).rejected


@query
def select_visits(spark, sf):
    """Each customer asks for its own orders; some ask for unknown or foreign ones."""
    v = t.visits(spark, sf).select("entity_id", "visit_id", "visit_date")
    e, i = F.col("entity_id"), F.col("visit_id")
    wanted = v.select("entity_id", "visit_id").unionByName(
        v.groupBy("entity_id").agg(F.min("visit_id").alias("visit_id"))
        .filter((e % 7 == 0) | (e % 5 == 0))
        .select(F.when(e % 7 == 0, e).otherwise(e + 1).alias("entity_id"),
                F.when(e % 7 == 0, -i).otherwise(i).alias("visit_id")))
    return texts(vt.select_visits(wanted, v, N, 10), "visit_date")


def stored(spark, sf):
    """The visits as a store of 16 buckets, and the store after the change log."""
    v = t.visits(spark, sf).select("entity_id", "visit_id", "visit_date", "amount", "status", "priority")
    before = VisitStore.create(shared_folder(spark, "store"), v, N, buckets=16)
    return before, *before.apply(t.change_log(spark, sf))


@query
def store_changes(spark, sf):
    """The change log applied to a store by whole buckets, read back from the newest version."""
    after = stored(spark, sf)[1]
    return rounded(texts(VisitStore.open(spark, after.root, N).read(), "visit_date"))


@query
def store_history(spark, sf):
    """Stored visits of known patients in order, as they were in the first version."""
    after = stored(spark, sf)[1]
    v = VisitStore.open(spark, after.root, N, 1).read().select("entity_id", "visit_id", "visit_date", "amount")
    patients = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return rounded(texts(vt.visit_history(v, patients, N), "visit_date"))


@query
def store_rejected(spark, sf):
    return stored(spark, sf)[2]


# --- models (no SQL counterpart: iterative fits) ------------------------------------------------

SMALL = {
    "logistic_regression": {"C": 1.0, "class_weight": "balanced", "max_iter": 20},
    "random_forest": {"n_estimators": 20, "max_depth": 5, "class_weight": "balanced"},
    "gradient_boosting": {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.9},
    "gradient_boosting_leafwise": {"n_estimators": 8, "num_leaves": 8, "max_depth": -1, "min_child_samples": 10},
    "sequence_network": {"hidden": [16], "epochs": 20},
}


def fitted(spark, sf, family, visits=None):
    """A model fitted on the training split, and the prepared tables."""
    kind = tr.chosen_representation(family)
    cohort = co.future_outcome_cohort(stored_visits(spark, sf) if visits is None else visits, N)
    ready = tr.prepare(cohort, representations=(kind,))
    train = ready.table(kind, "train")
    art = tr.fit_representation(train, N, kind, 4)
    return replace(art, model=mo.fit(family, SMALL[family], tr.labelled(art, train, ready.targets))), ready


def fit_and_score(family):
    def run(spark, sf):
        art, ready = fitted(spark, sf, family)
        scored = art.model.predict(art.features_of(ready.table(art.representation)), art.threshold)
        return rounded(scored.select("entity_id", "n_visits", "p", "prediction").join(ready.targets, "entity_id"))
    return run


for _family in SMALL:
    _fn = fit_and_score(_family)
    _fn.__name__ = f"fit_score_{_family}"
    query(_fn)


@query
def score_batch(spark, sf):
    """All visits of all entities scored with a saved and reloaded model."""
    v = stored_visits(spark, sf)
    art, _ = fitted(spark, sf, "logistic_regression", v)
    path = shared_folder(spark, "artifact")
    art.save(spark, path)
    return rounded(tr.Artifact.load(spark, path, N).score(v))


def trained(spark, sf, families=("logistic_regression", "random_forest", "sequence_network")):
    trials = [sr.Trial(i, f, tuple(SMALL[f].items())) for i, f in enumerate(families)]
    return tr.train(spark, t.visits(spark, sf), N, trials)


@query
def leaderboard(spark, sf):
    return rounded(trained(spark, sf).search.leaderboard.drop(
        "train_seconds", "inference_seconds_per_entity"))


@query
def end_to_end_test_metrics(spark, sf):
    return rounded(trained(spark, sf, ("logistic_regression",)).test_metrics)


@query
def robustness(spark, sf):
    art, ready = fitted(spark, sf, "logistic_regression")
    return rounded(robustness_sweep(ready.table(tr.SEQUENCE, "test"), ready.targets, art, [
        Condition(), Condition("remove_measurements", 0.3), Condition("remove_visits", 0.5),
        Condition("truncate_to_recent_visits", 2.0), Condition("jitter_visit_timing", 30.0)]))


def explained(spark, sf, family="logistic_regression"):
    art, ready = fitted(spark, sf, family)
    return art, tr.labelled(art, ready.table(art.representation, "test"), ready.targets)


@query
def permutation_importance(spark, sf):
    art, data = explained(spark, sf)
    names = art.preprocessor.output_names
    imp = ex.permutation_importance(art.model, data, "entity_id", names, repeats=5)
    listed = spark.createDataFrame([(n,) for n in names], "feature string")
    return rounded(ex.global_ranking(imp, readable_names(listed, N), top=len(names)))


@query
def linear_contributions(spark, sf):
    art, data = explained(spark, sf)
    return rounded(ex.linear_contributions(art.model, data, "entity_id", art.preprocessor.output_names))


@query
def ablation_contributions(spark, sf):
    art, data = explained(spark, sf, "random_forest")
    return rounded(ex.ablation_contributions(art.model, data, "entity_id", art.preprocessor.output_names))


@query
def temporal_occlusion(spark, sf):
    art, ready = fitted(spark, sf, "sequence_network")
    obs = ready.table(tr.SEQUENCE, "test")
    names = se.layout(obs, N, art.vocab)
    x = pp.apply_sequence_stats(se.sequences(obs, N, art.vocab), art.sequence_stats, names)

    def score(df):
        keep = [c for c in df.columns if c != "features"]
        return art.model.predict_proba(tr.flatten(df, "entity_id", ["mask"], tuple(
            c for c in keep if c != "entity_id")))

    return rounded(ex.temporal_occlusion(x, "entity_id", score))


@query
def feature_names(spark, sf):
    """Readable names of the processed columns that the data give rise to."""
    w = wide_all(spark, sf, segment=True)
    numeric, categorical = tr.wide_columns(S, 4)
    encoded = pp.fit_categories(w, categorical).select(F.concat_ws("__", "feature", "category").alias("feature"))
    listed = spark.createDataFrame([(c,) for c in numeric], "feature string").unionByName(encoded)
    return readable_names(listed, S)


# --- a scorer with fixed coefficients behind the models' contract --------------------------------

class FixedScorer:
    """P = 1 / (1 + exp(-(b + w . x))) with given coefficients; stands in for a fitted model."""

    def __init__(self, intercept: float, weights: list[float]):
        self.intercept, self.weights = intercept, weights

    def predict_proba(self, df):
        x = vector_to_array("features")
        z = sum((F.lit(w) * F.get(x, F.lit(i)) for i, w in enumerate(self.weights)), F.lit(self.intercept))
        return df.withColumn("p", 1 / (1 + F.exp(-z)))


FIXED = FixedScorer(-0.4, [0.9, -0.7, 0.35, -0.25])
FIXED_NAMES = ["amount_latest", "amount_std", "quantity_mean", "n_obs_visits"]


def fixed_data(spark, sf):
    """entity_id, features, label: four wide features brought near one scale, missing ones 0."""
    cohort = co.future_outcome_cohort(stored_visits(spark, sf), N).with_written_audit()
    wide = wi.wide_features(cohort.observations, N, bounded=True)
    scale = {"amount_latest": 150000.0, "amount_std": 80000.0, "quantity_mean": 100.0, "n_obs_visits": 4.0}
    x = [F.coalesce(F.col(c).cast("double") / s, F.lit(0.0)) for c, s in scale.items()]
    rows = wide.select("entity_id", array_to_vector(F.array(*x)).alias("features"))
    labels = cohort.targets.filter("target is not null").select("entity_id", F.col("target").alias("label"))
    return rows.join(labels, "entity_id")


@query
def score_fixed(spark, sf):
    """Probability and class of every eligible entity under fixed coefficients."""
    scored = FIXED.predict_proba(fixed_data(spark, sf))
    return rounded(scored.select("entity_id", "p", (F.col("p") >= 0.5).cast("int").alias("prediction"), "label"))


@query
def score_fixed_metrics(spark, sf):
    """AUROC, Brier score and accuracy of these scores."""
    row = me.metric_row(FIXED.predict_proba(fixed_data(spark, sf)), 0.5, y="label")
    return rounded(row.select("auroc", "brier", "accuracy"))


def fixed_contributions(spark, sf):
    data = fixed_data(spark, sf)
    return ex.ablation_contributions(FIXED, data, "entity_id", FIXED_NAMES, top=4), data


@query
def permutation_fixed(spark, sf):
    """Mean fall of the AUROC when one feature comes from another entity, three times."""
    return rounded(ex.permutation_importance(FIXED, fixed_data(spark, sf), "entity_id", FIXED_NAMES, repeats=3))


@query
def ablation_fixed(spark, sf):
    """Change of each entity's probability without each feature."""
    return rounded(fixed_contributions(spark, sf)[0].select("entity_id", "feature", "value", "contribution", "direction"))


@query
def explanation_records_fixed(spark, sf):
    """The same with probability, class, threshold and readable names."""
    out, data = fixed_contributions(spark, sf)
    names = readable_names(spark.createDataFrame([(n,) for n in FIXED_NAMES], "feature string"), N)
    records = ex.explanation_records(out, FIXED.predict_proba(data), names, "entity_id", 0.5)
    return rounded(records.select("entity_id", "probability", "predicted_class", "threshold", "feature",
                                  "readable_name", "contribution"))


# --- the real artifact around a model with fixed coefficients ---------------------------------------

class FixedModel:
    """A classifier with given coefficients by name of the encoded feature, as Spark ML models transform."""

    def __init__(self, names: list[str], intercept: float, weights: dict[str, float]):
        self.intercept, self.terms = intercept, [(names.index(n), w) for n, w in weights.items()]

    def transform(self, df):
        x = vector_to_array("features")
        z = sum((F.lit(w) * F.get(x, F.lit(i)) for i, w in self.terms), F.lit(self.intercept))
        p = 1 / (1 + F.exp(-z))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


FIXED_WEIGHTS = {"amount_latest": 0.8, "amount_delta": -0.3, "quantity_mean": 0.5, "n_obs_visits": -0.6,
                 "status_latest__F": 0.4, "status_latest__P": -0.9, "priority_latest__1-URGENT": 0.25}


def fixed_artifact(visits):
    """An artifact whose preprocessing is fitted on all wide rows."""
    shell = tr.fit_representation(wi.wide_features(visits, N), N, tr.WIDE, 4)
    names = shell.preprocessor.output_names
    return replace(shell, model=mo.FittedModel("fixed", FixedModel(names, 0.1, FIXED_WEIGHTS)))


@query
def score_batch_fixed(spark, sf):
    """All visits of all entities through the artifact: wide rows, fitted encoding, score and class."""
    v = stored_visits(spark, sf)
    return rounded(fixed_artifact(v).score(v))


def score_requests(spark, sf):
    """A request per entity for its last visits, and some that have to be refused for each reason."""
    o = t.table(spark, sf, "orders")
    e, i = F.col("o_custkey"), F.col("o_orderkey")
    own = o.groupBy(e.alias("entity_id")).agg(F.array_sort(F.collect_list(i)).alias("ids"))
    k = F.col("entity_id")
    ids = (F.when(k % 11 == 0, F.array().cast("array<bigint>")).when(k % 11 == 1, F.transform("ids", lambda x: -x))
           .when(k % 11 == 2, F.col("ids")).otherwise(F.slice("ids", 1, 4)))
    who = F.when(k % 11 == 3, -k).when(k % 11 == 4, k + 1).otherwise(k)
    return own.select(k.alias("request"), who.alias("entity_id"), ids.alias("visit_ids"))


@query
def score_selection_fixed(spark, sf):
    """Requests for chosen visits with all statuses, the accepted ones scored through the artifact."""
    patients = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    v = stored_visits(spark, sf)
    out = score_selection(fixed_artifact(v), score_requests(spark, sf), patients, v)
    return rounded(out.select("request", "entity_id", "n_visits", "status", F.array_join("visit_ids", ",").alias("visit_ids"),
                              F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"), "p", "prediction"))


# --- undefined values -----------------------------------------------------------------------------

def gappy_predictions(spark, sf):
    """Predictions in which every tenth score is NULL and every seventh NaN."""
    i = F.col("doc_id")
    return t.predictions(spark, sf).withColumn(
        "p", F.when(i % 10 == 0, F.lit(None)).when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p")))


@query
def auroc_undefined_scores(spark, sf):
    """Areas over the defined scores only."""
    p = gappy_predictions(spark, sf)
    return rounded(me.auroc(p, ["lang"]).join(me.auprc(p, ["lang"]), "lang"))


@query
def confusion_undefined_scores(spark, sf):
    """Confusion counts and rates over the defined scores only."""
    return rounded(me.threshold_rates(gappy_predictions(spark, sf), 0.3, ["source"]))


@query
def brier_undefined_scores(spark, sf):
    return rounded(me.brier(gappy_predictions(spark, sf), ["lang"]))


@query
def f1_undefined_scores(spark, sf):
    return rounded(me.best_f1_threshold(gappy_predictions(spark, sf), by=["lang"]))


@query
def undefined_scores(spark, sf):
    return me.undefined_scores(gappy_predictions(spark, sf), ["lang"])


def gappy_visits(spark, sf):
    """Visits in which every fifth amount is NaN."""
    return t.visits(spark, sf).withColumn("amount", F.when(
        F.col("visit_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("amount")))


@query
def wide_nan_input(spark, sf):
    """Summaries in which NaN is a missing value."""
    w = wi.wide_features(gappy_visits(spark, sf), N)
    return rounded(w.select("entity_id", "amount_latest", "amount_mean", "amount_min", "amount_max", "amount_std",
                            "amount_delta"))


@query
def fit_numeric_nan(spark, sf):
    """Median, mean and scale over the values that are numbers."""
    return rounded(pp.fit_numeric(gappy_visits(spark, sf), ["amount", "quantity"]))


@query
def cohort_numeric_flag(spark, sf):
    """The flagged cohort with the future flag as a number, 2.0 for future visits."""
    rows = t.visits(spark, sf)
    late = F.col("visit_date") >= F.lit(t.FUTURE_FROM).cast("date")
    return co.future_outcome_cohort(rows.withColumn("is_future_visit", F.when(late, 2.0).otherwise(0.0)), N).status
