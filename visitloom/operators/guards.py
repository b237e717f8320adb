"""Keeping future information out of observation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import missing_to_null
from ..spec import LeakageError, VisitSpec


def strip_leakage(df: DataFrame, spec: VisitSpec) -> DataFrame:
    """Drop the exact leakage names."""
    return df.drop(*[c for c in df.columns if c in spec.leakage])


def leakage_candidates(columns: list[str], spec: VisitSpec, extra: tuple[str, ...] = ()) -> list[str]:
    """Columns whose lower-cased name contains a leakage pattern."""
    patterns = [p.lower() for p in (*spec.leakage_patterns, *extra)]
    return [c for c in columns if any(p in c.lower() for p in patterns)]


def safe_columns(df: DataFrame, spec: VisitSpec) -> list[str]:
    """Columns that may serve as model input."""
    unsafe = set(leakage_candidates(df.columns, spec)) | set(spec.leakage)
    return [c for c in df.columns if c not in unsafe]


def select_safe(df: DataFrame, spec: VisitSpec) -> DataFrame:
    return df.select(*safe_columns(df, spec))


def refuse_leakage(df: DataFrame, spec: VisitSpec, who: str) -> None:
    """Raise when a feature operator is handed a leakage column."""
    found = [c for c in df.columns if c in spec.leakage]
    if found:
        raise LeakageError(f"{who} received leakage columns {found}; pass cohort observations")


def clean_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every missing spelling becomes NULL, other text is trimmed."""
    return df.withColumns({c: missing_to_null(F.col(c)) for c in columns if c in df.columns})
