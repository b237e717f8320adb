"""Training, search, scoring and explanations end to end on the given tables."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import tables
from visitloom.operators import metrics as me, sequence as se
from visitloom.operators.names import readable_names
from visitloom.operators.preprocess import apply_sequence_stats
from visitloom.plans import explain as ex, models as mo, search as sr, training as tr
from visitloom.plans.robustness import robustness_sweep
from visitloom.sources import sinks
from visitloom.spec import Condition, LeakageError

SF = "/root/testdata/sf0.01"
N = tables.NARROW
TRIALS = [
    sr.Trial(0, "logistic_regression", (("C", 0.5), ("max_iter", 15), ("class_weight", "balanced"))),
    sr.Trial(1, "random_forest", (("n_estimators", 10), ("max_depth", 4))),
    sr.Trial(2, "sequence_network", (("hidden", [8]), ("epochs", 10))),
    sr.Trial(3, "logistic_regression", (("C", -1.0),)),
]


@pytest.fixture(scope="module")
def result(spark):
    return tr.train(spark, tables.visits(spark, SF), N, TRIALS, parallelism=2)


def test_run_adds_up(spark, result, tmp_path):
    counts = result.cohort.counts().first()
    split = {r.split: r["count"] for r in result.prepared.targets.groupBy("split").count().collect()}
    assert sum(split.values()) == counts.eligible
    test = result.test_metrics.first()
    assert test.test_n_samples == split["test"] == test.test_TP + test.test_FP + test.test_TN + test.test_FN
    assert 0 <= test.test_auroc <= 1
    board = result.search.leaderboard.collect()
    assert {r.trial: r.state for r in board}[3] == "failed"      # on the board, last, without metrics
    assert board[-1].trial == 3 and board[-1].validation_auroc is None
    scores = [r.validation_auroc for r in board if r.state == "complete"]
    assert scores == sorted(scores, reverse=True) and board[0].trial == result.search.best.number
    result.save(spark, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "leaderboard"), header=True).count() == len(board)
    assert spark.read.json(str(tmp_path / "best_config")).first().trial == board[0].trial
    saved = sinks.read_record(spark, str(tmp_path / "test_metrics"), result.test_metrics).first()
    assert saved == test
    assert sinks.read_record(spark, str(tmp_path / "split_statistics")).count() == 3


def test_threshold_chosen_on_validation(spark, result):
    tuned = tr.train(spark, None, N, TRIALS[:1], cohort=result.cohort, threshold=None)
    val = tuned.search.models[0].predict_proba(tr.labelled(
        tr.fit_representation(tuned.prepared.table(tr.WIDE, "train"), N, tr.WIDE, 4),
        tuned.prepared.table(tr.WIDE, "validation"), tuned.prepared.targets))
    assert tuned.artifact.threshold == me.best_f1_threshold(val, y="label").first().threshold
    assert tuned.test_metrics.first().test_threshold == tuned.artifact.threshold


def test_scoring_refuses_future_columns(spark, result):
    obs = result.prepared.table(tr.SEQUENCE)
    with pytest.raises(LeakageError):
        result.artifact.score(obs.withColumn("target", F.lit(1)))


@pytest.mark.parametrize("trial", [0, 2])
def test_saved_artifact_scores_the_same(spark, result, tmp_path, trial):
    t = TRIALS[trial]
    train = result.prepared.table(t.representation, "train")
    art = tr.fit_representation(train, N, t.representation, 4)
    art.model = mo.fit(t.family, dict(t.params), tr.labelled(art, train, result.prepared.targets))
    art.save(spark, str(tmp_path))
    again = tr.Artifact.load(spark, str(tmp_path), N)
    obs = result.prepared.table(tr.SEQUENCE)
    a = {r.entity_id: r.p for r in art.score(obs, bounded=True).collect()}
    b = {r.entity_id: r.p for r in again.score(obs, bounded=True).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert all(0 <= p <= 1 for p in a.values())
    # one entity, fewer columns: scored alone it gets the same probability
    one = obs.filter(F.col("entity_id") == min(a))
    assert math.isclose(art.score(one).first().p, a[min(a)], abs_tol=1e-9)
    assert art.score(one.drop("discount", "priority")).count() == 1


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1.0,)] + [(0.0,)] * 3, "label double")
    assert {r.label: r.weight for r in mo.balanced_weights(df).collect()} == {1.0: 2.0, 0.0: 4 / 6}


def test_trials_are_reproducible():
    a = sr.draw_trials(20, list(sr.SPACES), seed=3)
    assert a == sr.draw_trials(20, list(sr.SPACES), seed=3) != sr.draw_trials(20, list(sr.SPACES), seed=4)
    assert {t.representation for t in a} == {"wide", "sequence"}


@pytest.mark.parametrize("family", ["gradient_boosting", "gradient_boosting_leafwise"])
def test_boosted_trees(result, family):
    train = result.prepared.table(tr.WIDE, "train")
    art = tr.fit_representation(train, N, tr.WIDE, 4)
    data = tr.labelled(art, train, result.prepared.targets)
    model = mo.fit(family, {"n_estimators": 3, "max_depth": 2, "num_leaves": 4, "subsample": 0.8}, data)
    assert me.auroc(model.predict_proba(data), y="label").first().auroc > 0.6


@pytest.fixture(scope="module")
def linear(result):
    train = result.prepared.table(tr.WIDE, "train")
    art = tr.fit_representation(train, N, tr.WIDE, 4)
    data = tr.labelled(art, train, result.prepared.targets).cache()
    art.model = mo.fit("logistic_regression", dict(TRIALS[0].params), data)
    return art, data


def test_linear_terms_add_up_to_the_log_odds(linear):
    art, data = linear
    names = art.preprocessor.output_names
    terms = ex.linear_contributions(art.model, data, "entity_id", names, top=len(names))
    total = {r.entity_id: r.s for r in terms.groupBy("entity_id").agg(F.sum("contribution").alias("s")).collect()}
    for r in art.model.predict_proba(data).limit(20).collect():
        odds = math.log(r.p / (1 - r.p))
        assert math.isclose(total[r.entity_id] + art.model.model.intercept, odds, abs_tol=1e-6)
    assert terms.filter("(contribution > 0) <> (direction = 'increases_risk')").count() == 0


def test_ablation_ranks(linear):
    art, data = linear
    names = art.preprocessor.output_names
    few = data.orderBy("entity_id").limit(5)
    out = ex.ablation_contributions(art.model, few, "entity_id", names, top=3).collect()
    assert {r.method for r in out} == {"ablation"} and len(out) <= 30
    for e in {r.entity_id for r in out}:
        mine = sorted((r for r in out if r.entity_id == e), key=lambda r: r["rank"])
        sizes = [abs(r.contribution) for r in mine]
        assert sizes == sorted(sizes, reverse=True)


def test_permutation_importance(linear):
    art, data = linear
    names = art.preprocessor.output_names
    weights = dict(zip(names, art.model.model.coefficients))
    imp = {r.feature: r.importance for r in ex.permutation_importance(
        art.model, data, "entity_id", names, repeats=2, rows_per_task=100).collect()}
    assert set(imp) == set(names)
    # a constant feature cannot matter
    const = [names[i] for i, (lo, hi) in enumerate(zip(*data.select(vector_to_array("features").alias("x")).agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(len(names))]),
        F.array(*[F.max(F.col("x")[i]) for i in range(len(names))])).first())) if lo == hi]
    assert all(abs(imp[c]) < 1e-12 for c in const)
    assert max(imp, key=imp.get) in sorted(names, key=lambda n: -abs(weights[n]))[:25]
    board = ex.global_ranking(art_frame(data.sparkSession, imp), readable_names(
        data.sparkSession.createDataFrame([(n,) for n in names], "feature string"), N), top=5).collect()
    assert [r["rank"] for r in board] == [1, 2, 3, 4, 5]


def art_frame(spark, imp):
    return spark.createDataFrame(list(imp.items()), "feature string, importance double")


def test_temporal_occlusion(spark, result):
    obs = result.prepared.table(tr.SEQUENCE)
    art = tr.fit_representation(obs, N, tr.SEQUENCE, 4)
    names = se.layout(obs, N, art.vocab)
    x = apply_sequence_stats(se.sequences(obs, N, art.vocab), art.sequence_stats, names)

    def score(df):   # a known score: the mean of the first feature over real steps
        first = F.aggregate("X", F.lit(0.0), lambda a, v: a + v[0])
        return df.withColumn("p", first)

    out = ex.temporal_occlusion(x, "entity_id", score)
    direct = x.select("entity_id", "mask", F.posexplode("X").alias("step", "v")).select(
        "entity_id", "step", F.col("v")[0].alias("own"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n"))
    both = out.join(direct, ["entity_id", "step"])
    assert both.filter("n > 1 AND abs(influence - own) > 1e-9").count() == 0
    assert both.filter("(is_real = 0) <> (rank = 0)").count() == 0
    assert both.groupBy("entity_id").agg(F.max("rank").alias("r"), F.max("n").alias("n")).filter("r <> n").count() == 0


def test_robustness(linear, result):
    art, _ = linear
    obs = result.prepared.table(tr.SEQUENCE)
    rows = {r.kind: r for r in robustness_sweep(obs, result.prepared.targets, art, [
        Condition(), Condition("remove_visits", 0.0), Condition("remove_measurements", 0.9)]).collect()}
    assert math.isclose(rows["baseline"].auroc, rows["remove_visits"].auroc)
    assert rows["remove_measurements"].auroc != rows["baseline"].auroc
    assert len({r.n_samples for r in rows.values()}) == 1


def test_names(spark):
    listed = ["hba1c_w3", "bmi_delta", "n_obs_visits", "sex_latest__M", "odd_name", "x_slope"]
    features = spark.createDataFrame([(n,) for n in listed], "feature string")
    got = {r.feature: r.readable_name for r in readable_names(features).collect()}
    assert got == {"hba1c_w3": "HbA1c at wave 3", "bmi_delta": "BMI (change / delta)",
                   "n_obs_visits": "Number of Observation Visits", "sex_latest__M": "Sex (latest) = M",
                   "odd_name": "Odd Name", "x_slope": "X (trend / slope)"}
