"""Column expressions used by the operators (all run inside the JVM)."""

from .columns import (
    as_flag, event, falling_cut, is_missing, missing_to_null, number_or_null, plus_days, quoted, require_columns, row_cuts, sort_cuts,
    text_cuts, try_date, uniform,
)

__all__ = [
    "as_flag", "event", "falling_cut", "is_missing", "missing_to_null", "number_or_null", "plus_days", "quoted", "require_columns", "row_cuts",
    "sort_cuts", "text_cuts", "try_date", "uniform",
]
