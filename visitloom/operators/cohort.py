"""Cohort construction: who is eligible, what was observed, what happened next.

Two shuffles on the entity: one for the observation window, one for the join of
all visits with the per-entity cutoff.  Nothing is windowed over a whole entity:
"first" and "last n" rows use :func:`first_rows`, the rest are aggregates with
map-side combine and an inner join that adaptive execution splits when one
entity is large.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions import as_flag, event, plus_days, require_columns, row_cuts
from ..sources.session import written
from ..spec import CohortRules, DataError, LeakageError, VisitSpec
from .guards import strip_leakage
from .ordered import first_rows

ELIGIBLE = "eligible"
TOO_FEW = "too_few_visits"
NO_FOLLOWUP = "no_followup"
PRIOR = "prior_condition"
NONE_IN_HORIZON = "none_in_horizon"
INCONSISTENT = "inconsistent_target"
NO_TARGET = "no_target"


@dataclass
class Cohort:
    """``status`` has one row per entity; ``audit`` and ``observations`` hold eligible entities only."""

    status: DataFrame
    audit: DataFrame
    observed: DataFrame      # kept observation rows of every entity, eligible or not
    spec: VisitSpec
    rules: CohortRules

    @property
    def observations(self) -> DataFrame:
        e = self.spec.entity
        return strip_leakage(self.observed.join(self.audit.select(e), e, "left_semi"), self.spec)

    def with_written_audit(self) -> "Cohort":
        """The audit as a written table, so that later steps do not derive it again."""
        return replace(self, audit=written(self.audit, "cohort_audit"))

    @property
    def targets(self) -> DataFrame:
        return self.audit.select(self.spec.entity, self.spec.target)

    def counts(self) -> DataFrame:
        return exclusion_counts(self.status, self.spec)


def future_outcome_cohort(df: DataFrame, spec: VisitSpec, rules: CohortRules = CohortRules(), **kw) -> Cohort:
    """Outcomes from visits in ``(cutoff, cutoff + horizon]``.

    With a future flag column the flag divides observation from future visits;
    without one the first ``max_visits`` visits are observation.
    """
    require_columns(df, [spec.entity, *spec.order], "future_outcome_cohort")
    flagged = spec.future in df.columns
    e, t = spec.entity, F.col(spec.time)
    order = [F.col(c) for c in spec.order]
    visits = df.filter(F.col(e).isNotNull()).withColumn("_event", event(spec, df.columns))
    if flagged:
        visits = visits.withColumn("_future", as_flag(visits, spec.future))
        seen = visits.groupBy(e).agg(
            F.count_if(~F.col("_future")).alias("_n"),
            F.max(F.when(~F.col("_future"), t)).alias("_cutoff"),
            F.max(F.when(~F.col("_future"), F.col("_event"))).alias("_prior"))
        observed = visits.filter(~F.col("_future"))
    else:
        visits = visits.withColumn("_future", F.lit(True))   # the cutoff alone divides them
        observed = first_rows(visits, [e], order, rules.max_visits, cuts=row_cuts(visits, spec.order), **kw)
        seen = observed.groupBy(e).agg(
            F.count(F.lit(1)).alias("_n"), F.max(t).alias("_cutoff"), F.max("_event").alias("_prior"))

    has_flag, has_measure = spec.flag in df.columns, spec.measure in df.columns
    after = F.col("_future") & (t > F.col("_cutoff"))
    ahead = visits.join(seen, e)
    inside = after & (t <= plus_days(ahead, "_cutoff", rules.horizon_days))
    facts = ahead.groupBy(e).agg(
        F.max("_n").alias("_n"), F.max("_cutoff").alias("_cutoff"), F.max("_prior").alias("_prior"),
        F.count_if(after).alias("_after"), F.count_if(inside).alias("n_in_horizon"),
        F.max(F.when(inside, F.col("_event"))).alias(spec.target),
        F.max(F.when(inside, F.col(spec.measure)) if has_measure else F.lit(None).cast("double"))
        .alias("max_measure"),
        F.max(F.when(inside, (F.coalesce(F.col(spec.flag), F.lit(0)) == 1).cast("int")) if has_flag
              else F.lit(0)).alias("any_flag"))

    rule = F.when(F.col("_n") < rules.min_visits, TOO_FEW)
    if rules.require_followup:
        rule = rule.when(F.col("_after") == 0, NO_FOLLOWUP)
    if rules.exclude_prior:
        rule = rule.when(F.col("_prior") == 1, PRIOR)
    rule = rule.when(F.col("n_in_horizon") == 0, NONE_IN_HORIZON).otherwise(ELIGIBLE)
    facts = facts.withColumn("status", rule)
    status = facts.select(
        e, "status", F.when(F.col("status") == ELIGIBLE, F.col(spec.target)).alias(spec.target))

    eligible = facts.filter(F.col("status") == ELIGIBLE)
    audit = eligible.select(
        e, spec.target, F.least(F.col("_n"), F.lit(rules.max_visits)).cast("int").alias("n_obs"),
        F.col("_cutoff").alias("cutoff"),
        plus_days(eligible, "_cutoff", rules.horizon_days).alias("horizon_end"),
        F.col("n_in_horizon").cast("int").alias("n_in_horizon"),
        F.round("max_measure", 2).alias("max_measure"), "any_flag")

    if flagged:   # the most recent observation visits
        observed = first_rows(observed, [e], [c.desc() for c in order], rules.max_visits,
                              cuts=row_cuts(observed, spec.order, newest=True), **kw)
    return Cohort(status, audit, observed.drop("_event", "_future", "_rank"), spec, rules)


def prelabeled_cohort(df: DataFrame, spec: VisitSpec, rules: CohortRules = CohortRules(), **kw) -> Cohort:
    """Targets read from the table; the *first* ``max_visits`` visits are kept."""
    require_columns(df, [spec.entity, *spec.order, spec.target], "prelabeled_cohort")
    e = spec.entity
    visits = df.filter(F.col(e).isNotNull())
    labels = visits.groupBy(e).agg(
        F.count(F.lit(1)).alias("_n"), F.min(spec.target).alias("_low"), F.max(spec.target).alias("_high"))
    first = first_rows(visits, [e], [F.col(c) for c in spec.order], rules.max_visits,
                       cuts=row_cuts(visits, spec.order), **kw)
    prior = (F.max((F.coalesce(F.col(spec.flag), F.lit(0)) == 1).cast("int"))
             if spec.flag in df.columns else F.lit(0))
    window = first.groupBy(e).agg(
        prior.alias("_prior"), F.count(F.lit(1)).alias("n_obs"), F.max(spec.time).alias("cutoff"))

    rule = (F.when(F.col("_n") < rules.min_visits, TOO_FEW)
            .when(F.col("_low") != F.col("_high"), INCONSISTENT)
            .when(F.col("_low").isNull(), NO_TARGET))
    if rules.exclude_prior:
        rule = rule.when(F.col("_prior") == 1, PRIOR)
    facts = labels.join(window, e).withColumn("status", rule.otherwise(ELIGIBLE))
    if rules.inconsistent_is_error:
        bad = facts.filter(F.col("status") == INCONSISTENT).select(e).limit(5).collect()
        if bad:
            raise DataError(f"entities with inconsistent targets, for example {[r[0] for r in bad]}")
    status = facts.select(
        e, "status", F.when(F.col("status") == ELIGIBLE, F.col("_low").cast("int")).alias(spec.target))
    eligible = facts.filter(F.col("status") == ELIGIBLE)
    audit = eligible.select(
        e, F.col("_low").cast("int").alias(spec.target), F.col("n_obs").cast("int").alias("n_obs"), "cutoff")
    return Cohort(status, audit, first.drop("_rank"), spec, rules)


def exclusion_counts(status: DataFrame, spec: VisitSpec) -> DataFrame:
    """One row: entities in, eligible, excluded by rule, positive, negative, positive rate."""
    def n(*names):
        return F.count_if(F.col("status").isin(*names))

    y = F.col(spec.target)
    return status.groupBy().agg(
        F.count(F.lit(1)).alias("input_entities"), n(ELIGIBLE).alias("eligible"),
        n(PRIOR).alias("excluded_prior"), n(TOO_FEW).alias("excluded_visits"),
        n(NO_FOLLOWUP, NONE_IN_HORIZON, NO_TARGET).alias("excluded_followup"),
        n(INCONSISTENT).alias("excluded_inconsistent"),
        F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"),
        F.coalesce(F.round(F.try_divide(F.count_if(y == 1), F.count_if(y.isin(0, 1))), 4), F.lit(0.0))
        .alias("positive_rate"))


def visits_after_cutoff(observations: DataFrame, audit: DataFrame, spec: VisitSpec) -> DataFrame:
    """Observation rows later than the cutoff of their entity; must be empty."""
    return (observations.join(audit.select(spec.entity, "cutoff"), spec.entity)
            .filter(F.col(spec.time) > F.col("cutoff")))


def assert_no_leakage(cohort: Cohort) -> None:
    bad = visits_after_cutoff(cohort.observations, cohort.audit, cohort.spec).limit(5).collect()
    if bad:
        raise LeakageError(f"observation rows after the cutoff, for example {bad}")
