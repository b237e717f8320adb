"""Column expressions: missing values, flags, dates, hashes, sort keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..spec import MISSING_TOKENS, DataError, VisitSpec

HASH_SEPARATOR = "|"


def require_columns(df: DataFrame, names: Iterable[str], who: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise DataError(f"{who} needs columns {absent}; found {df.columns}")


def quoted(name: str) -> Column:
    """A column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(col: Column) -> Column:
    """True for NULL and for every spelling of a missing value."""
    return col.isNull() | F.lower(F.trim(col.cast("string"))).isin(*MISSING_TOKENS)


def missing_to_null(col: Column) -> Column:
    """Trimmed text, NULL for any missing spelling."""
    return F.when(~is_missing(col), F.trim(col.cast("string")))


def as_flag(df: DataFrame, name: str) -> Column:
    """A flag column as boolean: numbers are true when not 0, text when it says true or 1, NULL and NaN are false."""
    col, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        flag = col
    elif isinstance(kind, T.NumericType):
        flag = (col != 0) & ~F.isnan(col.cast("double"))
    else:
        flag = F.lower(F.trim(col.cast("string"))).isin("true", "1")
    return F.coalesce(flag, F.lit(False))


def number_or_null(col: Column) -> Column:
    """A number, NULL for NaN: a measurement that is not there."""
    number = col.cast("double")
    return F.when(~F.isnan(number), number)


def falling_cut(col: Column) -> Column:
    """A number that never decreases along ``col`` in descending order, where NaN comes first and NULL last."""
    number = col.cast("double")
    return (F.when(number.isNull(), F.lit(float("nan"))).when(F.isnan(number), F.lit(float("-inf")))
            .otherwise(-number))


def row_cuts(df: DataFrame, names: Iterable[str], *, newest: bool = False) -> list[Column]:
    """:func:`sort_cuts` with NULL as a value of its own: first in rising order, last where the ``newest`` lead."""
    cuts = sort_cuts(df, names)
    return [falling_cut(c) for c in cuts] if newest else [F.coalesce(c, F.lit(float("-inf"))) for c in cuts]


def try_date(col: Column, fmt: str | None = None) -> Column:
    """Date of a text column, NULL where it does not parse."""
    parsed = F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
    return parsed.cast("date")


def event(spec: VisitSpec, columns: Iterable[str]) -> Column:
    """1 when a visit shows the event, by flag or by measure, else 0."""
    present = set(columns)
    hit = F.lit(False)
    if spec.flag in present:
        hit = hit | F.coalesce(F.col(spec.flag) == 1, F.lit(False))
    if spec.measure in present:
        hit = hit | F.coalesce(F.col(spec.measure) >= spec.threshold, F.lit(False))
    return hit.cast("int")


def plus_days(df: DataFrame, name: str, days: int | Column) -> Column:
    """A date or timestamp column moved by whole days."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.date_add(F.col(name), days)
    return F.col(name) + F.make_dt_interval(days=days if isinstance(days, Column) else F.lit(days))


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the given values.

    The first 32 bits of an MD5, so the same value can be had in other SQL engines.
    It is independent of partitioning, row order and the other rows.
    """
    text = F.concat_ws(
        HASH_SEPARATOR, F.lit(str(seed)),
        *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def text_cuts(col: Column, pieces: int = 3) -> list[Column]:
    """Numbers that sort like the first bytes of a text, six bytes at a time."""
    code = F.hex(F.encode(col, "UTF-8"))
    return [
        F.conv(F.rpad(F.substring(code, 12 * i + 1, 12), 12, "0"), 16, 10).cast("double")
        for i in range(pieces)
    ]


def sort_cuts(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Numbers that never decrease along ``names``; see ``operators.ordered``."""
    cuts: list[Column] = []
    for name in names:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.DateType):
            cuts.append(F.unix_date(col).cast("double"))
        elif isinstance(kind, T.TimestampNTZType):
            cuts.append(F.unix_micros(col.cast("timestamp")).cast("double"))
        elif isinstance(kind, T.TimestampType):
            cuts.append(F.unix_micros(col).cast("double"))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            cuts.append(col.cast("double"))
        else:
            cuts.extend(text_cuts(col.cast("string")))
    return cuts
