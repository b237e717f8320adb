"""Names and settings shared by all operators.

Every operator takes a :class:`VisitSpec`, which says which columns of a long
visit table play which role.  Nothing else in the library names a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# The clinical layout, leakage names and missing spellings that
# results must agree on.
# ---------------------------------------------------------------------------
CLINICAL_NUMERIC = (
    "hba1c", "fasting_glucose", "bmi", "systolic_bp", "diastolic_bp",
    "ldl_cholesterol", "hdl_cholesterol", "triglycerides", "heart_rate", "age_at_visit",
)
CLINICAL_CATEGORICAL = (
    "sex", "smoking_status", "physical_activity_level",
    "family_history_diabetes", "metformin_use", "hypertension_diagnosis",
)
YES_NO_COLUMNS = ("family_history_diabetes", "metformin_use", "hypertension_diagnosis")
LEAKAGE_COLUMNS = (
    "target", "is_future_visit", "future_hba1c", "future_glucose", "future_diabetes",
    "diabetes_progression", "diagnosis_after", "post_outcome", "outcome",
)
LEAKAGE_PATTERNS = (
    "target", "diabetes_progression", "future_diabetes", "outcome",
    "diagnosis_after", "post_outcome", "future_hba1c", "future_glucose",
)
MISSING_TOKENS = ("", "nan", "none", "<na>")
MISSING_LABEL = "<MISSING>"
UNKNOWN_LABEL = "<UNK>"


class LeakageError(ValueError):
    """A column that carries future information reached a feature operator."""


class DataError(ValueError):
    """Input rows break a rule that the caller asked to enforce."""


@dataclass(frozen=True)
class VisitSpec:
    """Column roles of a long visit table (one row per entity and visit)."""

    entity: str = "patient_id"
    time: str = "visit_date"
    visit_id: str | None = None          # breaks ties between visits of one day
    numeric: tuple[str, ...] = CLINICAL_NUMERIC
    categorical: tuple[str, ...] = CLINICAL_CATEGORICAL
    yes_no: tuple[str, ...] = YES_NO_COLUMNS
    flag: str | None = "diabetes_diagnosis"   # event flag, 1 = event
    measure: str | None = "hba1c"             # event when measure >= threshold
    threshold: float = 6.5
    future: str = "is_future_visit"
    target: str = "target"
    leakage: tuple[str, ...] = LEAKAGE_COLUMNS
    leakage_patterns: tuple[str, ...] = LEAKAGE_PATTERNS

    @property
    def order(self) -> list[str]:
        """Columns that order the visits of one entity."""
        return [self.time] + ([self.visit_id] if self.visit_id else [])


@dataclass(frozen=True)
class CohortRules:
    """Rules of cohort construction."""

    min_visits: int = 3
    max_visits: int = 4
    horizon_days: int = 365
    exclude_prior: bool = True
    require_followup: bool = True
    inconsistent_is_error: bool = True

    def __post_init__(self) -> None:
        if self.min_visits < 1 or self.max_visits < self.min_visits:
            raise ValueError("need 1 <= min_visits <= max_visits")
        if self.horizon_days < 1:
            raise ValueError("horizon_days must be at least 1")


@dataclass(frozen=True)
class SplitSizes:
    """Shares of the three splits."""

    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        shares = (self.train, self.validation, self.test)
        if abs(sum(shares) - 1.0) > 1e-6:
            raise ValueError(f"split shares must sum to 1, got {sum(shares):.6f}")
        if not all(0.0 < s < 1.0 for s in shares):
            raise ValueError(f"every split share must lie in (0, 1), got {shares}")


@dataclass
class Condition:
    """What a perturbation did: its kind, strength and parameters."""

    kind: str = "baseline"
    strength: float | None = None
    params: dict = field(default_factory=dict)
