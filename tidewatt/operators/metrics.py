"""Forecast metrics as aggregate expressions over rows where all inputs are finite."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axis import Axis, micros
from ..functions.calendar import calendar_value
from ..functions.missing import number
from ..functions.special import normal_cdf, normal_pdf
from .time_axis import frequency

#: Metrics that ``percent`` multiplies by 100.
PERCENT = ("nmae", "nrmse", "ncrps")


def _error(x: dict) -> Column:
    return x["p"] - x["t"]


def r2(x: dict) -> Column:
    """1 - squared error / squared deviation; a constant truth gives 1 where exact, else 0; null below two rows."""
    both = x["t"].isNotNull() & x["p"].isNotNull()
    t, sq = F.when(both, x["t"]), F.avg(_error(x) * _error(x))
    return F.when(F.count(_error(x)) < 2, None).when(F.max(t) == F.min(t), F.when(sq == 0, 1.0).otherwise(0.0)).otherwise(1 - sq / F.nullif(F.var_pop(t), F.lit(0.0)))


def crps(x: dict) -> Column:
    s = F.greatest(x["s"], F.lit(1e-12))
    z = (x["t"] - x["p"]) / s
    return F.avg(F.when(x["s"].isNotNull(), s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))))


#: Name -> (inputs besides truth and prediction, aggregate).
METRICS: dict[str, tuple[tuple[str, ...], Callable[[dict], Column]]] = {
    "mae": ((), lambda x: F.avg(F.abs(_error(x)))),
    "mse": ((), lambda x: F.avg(_error(x) * _error(x))),
    "rmse": ((), lambda x: F.sqrt(F.avg(_error(x) * _error(x)))),
    "r2": ((), r2),
    "bias": ((), lambda x: F.avg(_error(x))),
    "mape": ((), lambda x: 100 * F.avg(F.when(F.abs(x["t"]) > 1e-9, F.abs(_error(x) / F.nullif(x["t"], F.lit(0.0)))))),
    "smape": ((), lambda x: 100 * F.avg(2 * F.abs(_error(x)) / F.nullif(F.abs(x["t"]) + F.abs(x["p"]), F.lit(0.0)))),
    "nmae": (("norm",), lambda x: F.avg(F.abs(_error(x))) / x["norm"]),
    "nrmse": (("norm",), lambda x: F.sqrt(F.avg(_error(x) * _error(x))) / x["norm"]),
    "crps": (("std",), crps),
    "ncrps": (("std", "norm"), lambda x: crps(x) / x["norm"]),
    "coverage": (("lower", "upper"), lambda x: 100 * F.avg(x["t"].between(x["lo"], x["hi"]).cast("double"))),
    "interval_width": (("lower", "upper"), lambda x: F.avg(x["hi"] - x["lo"])),
}


def register_metric(name: str, fn: Callable[[dict], Column], needs=()) -> None:
    """``fn`` gets columns t, p, s, lo, hi and the number norm, and returns an aggregate."""
    METRICS[name] = (tuple(needs), fn)


def aggregates(truth: str, prediction: str, metrics=("mae", "rmse", "r2"), *, norm=None, std=None, lower=None, upper=None, percent: bool = False) -> list[Column]:
    """Aliased aggregates; a metric whose inputs are missing raises ValueError."""
    given = {"norm": norm, "std": std, "lower": lower, "upper": upper}
    t, p = number(truth), number(prediction)
    opt = lambda c: None if c is None else number(c)
    both = t.isNotNull() & p.isNotNull()
    x = {"t": F.when(both, t), "p": F.when(both, p), "s": opt(std), "lo": opt(lower), "hi": opt(upper), "norm": norm}
    out = []
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}; known: {sorted(METRICS)}")
        needs, fn = METRICS[m]
        if lacking := [k for k in needs if given[k] is None]:
            raise ValueError(f"{m} needs {lacking}")
        y = x | ({"t": number(truth)} if m == "coverage" else {})
        out.append((fn(y) * 100 if percent and m in PERCENT else fn(y)).alias(m))
    return out


def evaluate(df: DataFrame, truth: str, prediction: str, metrics=("mae", "rmse", "r2"), keys=(), **options) -> DataFrame:
    """One row of metrics, or one for each combination of ``keys``."""
    return df.groupBy(*keys).agg(*aggregates(truth, prediction, metrics, **options))


def evaluate_by_group(df: DataFrame, axis: Axis, truth: str, prediction: str, by: str | Callable[[Column], Column] = "hour", metrics=("nmae", "nrmse", "r2"), **options) -> DataFrame:
    """``group, n`` and metrics by a calendar feature, or by any expression of the timestamp."""
    group = by(F.col(axis.ts)) if callable(by) else calendar_value(axis.ts, by)
    return df.withColumn("group", group).groupBy(*axis.keys, "group").agg(F.count("*").alias("n"), *aggregates(truth, prediction, metrics, **options))


def windows(df: DataFrame, axis: Axis, window: int | str, step: int | str | None = None, start: str = "first") -> DataFrame:
    """``df`` with a row for each window that a row is in, and the window's number ``window_id`` from 0. Windows are
    rows, of which a last part is left out, or durations, which must end by a step after the last row."""
    if start not in ("first", "midnight"):
        raise ValueError("start must be first or midnight")
    step = window if step is None else step
    us = axis.micros()
    rows = axis.positions(df).withColumn("__us", us)
    midnight = F.min(F.when(F.pmod(us, F.lit(86_400_000_000)) < 60_000_000, F.col("__rn"))).over(axis.whole())
    rows = rows.withColumn("__first", F.coalesce(midnight, F.lit(1)) if start == "midnight" else F.lit(1))
    rows = rows.withColumns({"__n": F.count("*").over(axis.whole()), "__last": F.max("__us").over(axis.whole()), "__t0": F.min(F.when(F.col("__rn") >= F.col("__first"), F.col("__us"))).over(axis.whole())})
    if isinstance(window, int):
        at, size, hop, end = F.col("__rn") - F.col("__first"), window, int(step), F.col("__n") - F.col("__first") + 1
    else:
        at, size, hop = F.col("__us") - F.col("__t0"), micros(window), micros(step)
        end = F.col("__last") + (frequency(df, axis) or 0) - F.col("__t0")
    first = F.greatest(F.floor((at - size) / hop) + 1, F.lit(0))
    last = F.least(F.floor(at / hop), F.floor((end - size) / hop))
    ids = F.when((at >= 0) & (last >= first), F.sequence(first, last))
    return rows.withColumn("window_id", F.explode(ids)).drop("__rn", "__us", "__first", "__n", "__last", "__t0")


def evaluate_by_window(df: DataFrame, axis: Axis, truth: str, prediction: str, window: int | str = 24, step=None, metrics=("nmae", "nrmse", "r2"), start: str = "first", **options) -> DataFrame:
    """``window_id, start, end, n`` and metrics of each window."""
    rows = windows(df, axis, window, step, start)
    return rows.groupBy(*axis.keys, "window_id").agg(F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"), F.count("*").alias("n"), *aggregates(truth, prediction, metrics, **options))


def summarize_windows(scores: DataFrame, metrics, keys=()) -> DataFrame:
    """``metric, mean, std, min, max`` over windows."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")) for m in metrics))
    return scores.groupBy(*keys).agg(each.alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")
