"""The ordered axis that all time-series operators work along."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_UNITS = {"us": 1, "ms": 10**3, "s": 10**6, "sec": 10**6, "t": 60 * 10**6, "min": 60 * 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def micros(duration: str | timedelta | float) -> int:
    """Microseconds of ``"15min"``, ``"1h"``, ``"5D"``, a timedelta, or a number of microseconds. A bare number
    in a string is ambiguous and raises ValueError."""
    if isinstance(duration, timedelta):
        return round(duration / timedelta(microseconds=1))
    if isinstance(duration, (int, float)) and not isinstance(duration, bool):
        return int(duration)
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)\s*", str(duration))
    if not found or found[2].lower() not in _UNITS:
        raise ValueError(f"not a duration: {duration!r}")
    return round(float(found[1] or 1) * _UNITS[found[2].lower()])


@dataclass(frozen=True)
class Axis:
    """Rows are ordered by ``ts`` within each combination of ``keys``; ``order`` breaks ties, for Spark has no
    stable sort. A series is the unit of a task unless ``chunk``, a duration, cuts it in stretches that are (see
    ``chunks``); without keys or chunks a window has all rows in one task. Rows of one time need ``order`` then."""

    ts: str = "ts"
    keys: tuple[str, ...] = ()
    order: str | None = None
    chunk: str | int | None = None

    def sorting(self, reverse: bool = False) -> list[Column]:
        cols = [F.col(c) for c in (self.ts, self.order) if c]
        return [c.desc() for c in cols] if reverse else [c.asc() for c in cols]

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.sorting())

    def reverse(self, *extra: str) -> WindowSpec:
        """The same rows backwards. What looks ahead without bound uses this: Spark evaluates frames that are
        unbounded ahead anew for each row."""
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.sorting(reverse=True))

    def whole(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra)

    def micros(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp"))

    def timed(self) -> WindowSpec:
        """Ordered by microseconds, for frames that are durations."""
        return Window.partitionBy(*self.keys).orderBy(self.micros())

    def positions(self, df: DataFrame, name: str = "__rn") -> DataFrame:
        """Number the rows of each series from 1."""
        return df.withColumn(name, F.row_number().over(self.window()).cast("long"))
