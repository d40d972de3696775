"""Time-aware features: calendar, cyclic, lags, rolling statistics, and windows for sequence models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis, micros
from ..functions.calendar import PERIODS, calendar_value, cyclic
from ..functions.missing import number
from .time_axis import frequency


def calendar_features(df: DataFrame, ts: str, features=("hour", "month", "day_of_year")) -> DataFrame:
    """Add upper-cased calendar columns."""
    return df.withColumns({f.upper(): calendar_value(ts, f) for f in features})


def cyclic_features(df: DataFrame, ts: str, periods, drop_original: bool = True, suffixes=("_SIN", "_COS")) -> DataFrame:
    """Sine and cosine of columns, or of calendar features that are no columns. ``periods`` maps names to periods,
    or lists calendar features with known periods."""
    periods = periods if isinstance(periods, dict) else {n: PERIODS[n.lower()] for n in periods}
    out = {}
    for n, p in periods.items():
        value = F.col(n) if n in df.columns else calendar_value(ts, n)
        name = n if n in df.columns else n.upper()
        out |= dict(zip((name + s for s in suffixes), cyclic(value, p), strict=True))
    return df.withColumns(out).drop(*(n for n in periods if drop_original and n in df.columns))


def _step(df: DataFrame, axis: Axis, freq) -> int:
    step = micros(freq) if freq is not None else frequency(df, axis)
    if not step:
        raise ValueError("no frequency is given and none can be inferred")
    return step


def require_unique(df: DataFrame, axis: Axis) -> None:
    if not df.groupBy(*axis.keys, axis.ts).count().where("count > 1").isEmpty():
        raise ValueError("duplicate timestamps")


def lag_features(df: DataFrame, axis: Axis, columns, lags, freq=None, check: bool = True) -> DataFrame:
    """Add ``{c}_lag_{k}``: the value exactly k steps earlier, null where that time has no row."""
    step = _step(df, axis, freq)
    if check:
        require_unique(df, axis)

    def lagged(rows: DataFrame, ax: Axis) -> DataFrame:
        return rows.withColumns({f"{c}_lag_{k}": F.first(number(c)).over(ax.timed().rangeBetween(-k * step, -k * step)) for c in columns for k in lags})

    return chunks.by_time(df, axis, lagged, max((k * step for k in lags), default=0)) if min(lags, default=0) >= 0 else lagged(df, axis)


_STATS = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "median": lambda v: F.percentile(v, F.lit(0.5))}


def rolling_features(df: DataFrame, axis: Axis, columns, windows, stats=("mean", "std"), freq=None, include_current: bool = False, ddof: int = 1) -> DataFrame:
    """Add ``{c}_roll_{stat}_{w}`` over the ``w`` steps before a row, or up to it; null unless at least ``w`` values
    are there. With ``include_current`` rows of one timestamp all count."""
    step = _step(df, axis, freq)
    if unknown := set(stats) - _STATS.keys():
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    fns = _STATS | ({"std": F.stddev_pop, "var": F.var_pop} if ddof == 0 else {})

    def rolled(rows: DataFrame, ax: Axis) -> DataFrame:
        out = {}
        for w in windows:
            frame = ax.timed().rangeBetween(-w * step + 1, 0) if include_current else ax.timed().rangeBetween(-w * step, -1)
            out |= {f"{c}_roll_{s}_{w}": F.when(F.count(number(c)).over(frame) >= w, fns[s](number(c)).over(frame)) for c in columns for s in stats}
        return rows.withColumns(out)

    return chunks.by_time(df, axis, rolled, max((w * step for w in windows), default=0))


def make_windows(df: DataFrame, axis: Axis, columns, lookback: int, freq=None, check_gaps: bool = True, ends: Column | None = None) -> DataFrame:
    """Keys, timestamp, position (from 0) and ``window`` (lookback x columns) for each row whose last ``lookback``
    rows are complete and, with ``check_gaps``, a step apart. Arrays are made only for rows that pass."""
    step = _step(df, axis, freq) if check_gaps and lookback > 1 else None
    good = F.lit(True)
    for c in columns:
        good = good & number(c).isNotNull()
    rows = chunks.positions(df, axis)
    rows = rows.withColumns({"__good": good.cast("int"), "__end": F.lit(True) if ends is None else F.coalesce(ends, F.lit(False))})

    def windowed(rows: DataFrame, ax: Axis) -> DataFrame:
        w = ax.window()
        whole = F.sum("__good").over(w.rowsBetween(1 - lookback, 0)) == lookback
        if step:
            rows = rows.withColumn("__near", F.coalesce(ax.micros() - F.lag(ax.micros()).over(w) == step, F.lit(False)).cast("int"))
            whole = whole & (F.sum("__near").over(w.rowsBetween(2 - lookback, 0)) == lookback - 1)
        values = F.collect_list(F.array(*(F.coalesce(number(c), F.lit(0.0)) for c in columns))).over(w.rowsBetween(1 - lookback, 0))
        return rows.withColumn("window", F.when(whole & F.col("__end"), values))

    found = chunks.by_rows(rows, axis, windowed, lookback)
    return found.select(*axis.keys, axis.ts, (F.col("__rn") - 1).alias("position"), "window").where("window IS NOT NULL")
