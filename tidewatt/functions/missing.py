"""The one definition of missing and zero values: null, NaN and infinities are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """A finite double, or null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_missing(c: str | Column) -> Column:
    return number(c).isNull()


def is_zero(c: str | Column) -> Column:
    return F.coalesce(number(c) == 0, F.lit(False))


def missing_flag(c: str | Column, nan: bool = True, zeros: bool = False) -> Column:
    parts = [is_missing(c)] * nan + [is_zero(c)] * zeros
    return parts[0] | parts[1] if len(parts) > 1 else parts[0] if parts else F.lit(False)


def numeric_columns(df, exclude=(), booleans: bool = False) -> list[str]:
    """Numeric columns of a frame, in order; booleans only on demand."""
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]
