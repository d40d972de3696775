"""Outlier detectors as column expressions, and what to do with what they find.

A detector has ``fit``, which returns named aggregates of a training frame (or none), and ``flag``, an
expression over a row, its window and the fitted values. Values to skip (missing, and on demand zeros) are
never flagged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis
from ..functions.missing import number, numeric_columns
from .fills import interpolated

ACTIONS = ("interpolate", "set_nan", "clip", "drop_rows", "flag")
DETECTORS: dict[str, type] = {}


def register(name: str) -> Callable[[type], type]:
    """Make a detector known by a name; a taken name raises KeyError."""

    def put(cls: type) -> type:
        if name.lower() in DETECTORS:
            raise KeyError(f"detector {name!r} is there already")
        DETECTORS[name.lower()] = cls
        return cls

    return put


def make_detector(name: str, params: dict | None = None):
    if name.lower() not in DETECTORS:
        raise KeyError(f"unknown detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[name.lower()](**(params or {}))


@dataclass(frozen=True)
class Detector:
    """``fit`` gets the values to use (null elsewhere) and the axis; ``flag`` those and a getter of fitted values;
    ``stages`` are columns that need windows of their own before ``flag``, evaluated one after another; ``reach`` is how
    many rows before and after a row all of them and ``flag`` look at."""

    def fit(self, value: Column, step: Column) -> dict[str, Column]:
        return {}

    def stages(self, x: str, axis: Axis) -> list[dict[str, Callable[[str], Column]]]:
        return []

    def reach(self) -> int:
        return 0

    def flag(self, x: str, axis: Axis, fitted: Callable[[str], Column]) -> Column:
        raise NotImplementedError

    def bounds(self, fitted: Callable[[str], Column]) -> tuple[Column, Column] | None:
        return None


def _nonzero(v: Column, exclude: bool) -> Column:
    return F.when(v != 0, v) if exclude else v


@register("zscore")
@dataclass(frozen=True)
class ZScore(Detector):
    threshold: float = 3.0
    exclude_zeros: bool = True
    min_points: int = 10
    ddof: int = 1

    def fit(self, value, step):
        v = _nonzero(value, self.exclude_zeros)
        std = F.stddev_samp(v) if self.ddof else F.stddev_pop(v)
        enough = F.count(v) >= self.min_points
        return {"mean": F.when(enough & (std > 0), F.avg(v)), "std": F.when(enough & (std > 0), std)}

    def flag(self, x, axis, fitted):
        return F.abs(F.col(x) - fitted("mean")) / fitted("std") > self.threshold

    def bounds(self, fitted):
        return fitted("mean") - self.threshold * fitted("std"), fitted("mean") + self.threshold * fitted("std")


@register("iqr")
@dataclass(frozen=True)
class IQR(Detector):
    factor: float = 1.5
    exclude_zeros: bool = True
    min_points: int = 10

    def fit(self, value, step):
        v = _nonzero(value, self.exclude_zeros)
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
        ok = (F.count(v) >= self.min_points) & (q[1] > q[0])
        return {"low": F.when(ok, q[0] - self.factor * (q[1] - q[0])), "high": F.when(ok, q[1] + self.factor * (q[1] - q[0]))}

    def flag(self, x, axis, fitted):
        return (F.col(x) < fitted("low")) | (F.col(x) > fitted("high"))

    def bounds(self, fitted):
        return fitted("low"), fitted("high")


def _centred(axis: Axis, window: int):
    """Rows of a centred window; an even one has one more row before than after."""
    return axis.window().rowsBetween(-(window // 2), (window - 1) // 2)


def _rolling_median(v: Column, w, least: int) -> Column:
    return F.when(F.count(v).over(w) >= least, F.percentile(v, F.lit(0.5)).over(w))


@register("hampel")
@dataclass(frozen=True)
class Hampel(Detector):
    window: int = 72
    n_sigmas: float = 3.0
    exclude_zeros: bool = True
    min_periods: int | None = None

    def reach(self):
        return 2 * (self.window // 2)

    def stages(self, x, axis):
        w, least = _centred(axis, self.window), self.min_periods or max(10, self.window // 3)
        v = _nonzero(F.col(x), self.exclude_zeros)
        return [
            {"dev": lambda p: F.abs(v - _rolling_median(v, w, least))},
            {"mad": lambda p: _rolling_median(F.col(f"{p}dev"), w, least)},
        ]

    def flag(self, x, axis, fitted):
        sigma = 1.4826 * fitted("mad")
        return (sigma > 0) & (fitted("dev") > self.n_sigmas * sigma)


@register("rolling_median")
@dataclass(frozen=True)
class RollingMedian(Detector):
    window: int = 24
    threshold: float = 3.0

    def reach(self):
        return self.window // 2

    def stages(self, x, axis):
        w, least = _centred(axis, self.window), max(3, self.window // 3)
        v = F.col(x)
        return [{"dev": lambda p: F.abs(v - _rolling_median(v, w, least)), "sd": lambda p: F.when(F.count(v).over(w) >= least, F.stddev_samp(v).over(w))}]

    def flag(self, x, axis, fitted):
        return fitted("dev") / F.nullif(fitted("sd"), F.lit(0.0)) > self.threshold


@register("diff")
@dataclass(frozen=True)
class Diff(Detector):
    threshold: float = 4.0
    abs_threshold: float | None = None

    def reach(self):
        return 1

    def fit(self, value, step):
        moved = F.when(step != 0, step)
        return {} if self.abs_threshold is not None else {"step": F.stddev_pop(moved)}

    def flag(self, x, axis, fitted):
        d = F.abs(F.col(x) - F.lag(x).over(axis.window()))
        if self.abs_threshold is not None:
            return d > float(self.abs_threshold)
        return (fitted("step") > 0) & (d > self.threshold * fitted("step"))


@register("physical")
@dataclass(frozen=True)
class Physical(Detector):
    lower: float | None = None
    upper: float | None = None

    def flag(self, x, axis, fitted):
        low = F.col(x) < self.lower if self.lower is not None else F.lit(False)
        return low | (F.col(x) > self.upper) if self.upper is not None else low

    def bounds(self, fitted):
        return F.lit(self.lower).cast("double"), F.lit(self.upper).cast("double")


class OutlierProcessor:
    """Detect outliers by column and act on those of the applied detectors. Statistics are learned per series
    by ``fit``, in one aggregate for all columns; physical limits always apply."""

    def __init__(self, axis: Axis, detectors=None, apply=None, limits=None, columns=None, action: str = "interpolate", ignore_zeros=False, method: str = "linear"):
        if action not in ACTIONS:
            raise ValueError(f"action must be one of {ACTIONS}")
        self.axis, self.action, self.method, self.columns, self.limits = axis, action, method, columns, limits or {}
        self.detectors = {"zscore": {}} if detectors is None else detectors
        self.apply = list(self.detectors) if apply is None else list(apply)
        if unknown := set(self.apply) - set(self.detectors):
            raise ValueError(f"apply names {sorted(unknown)}, which are not among the detectors")
        self.ignore_zeros = ignore_zeros
        self.fitted: DataFrame | None = None

    def _of(self, c: str) -> dict[str, Detector]:
        found = {n: make_detector(n, p) for n, p in self.detectors.items()}
        low, high = self.limits.get(c, (None, None))
        return found | ({"physical": Physical(low, high)} if (low, high) != (None, None) else {})

    def _used(self, df: DataFrame) -> list[str]:
        return [c for c in (self.columns if self.columns is not None else numeric_columns(df, (*self.axis.keys, self.axis.ts))) if c in df.columns]

    def _value(self, c: str) -> Column:
        skip = self.ignore_zeros is True or isinstance(self.ignore_zeros, (list, tuple, set)) and c in self.ignore_zeros
        return F.when(number(c) != 0, number(c)) if skip else number(c)

    def fit(self, df: DataFrame) -> "OutlierProcessor":
        self.used = self._used(df)
        rows = df.select(*self.axis.keys, self.axis.ts, *([self.axis.order] if self.axis.order else []), *(self._value(c).alias(f"{c}__x") for c in self.used))
        if "diff" in self.detectors:
            rows = chunks.by_rows(rows, self.axis, lambda r, ax: r.withColumns({f"{c}__step": F.col(f"{c}__x") - F.lag(f"{c}__x").over(ax.window()) for c in self.used}), 1)
        aggs = [e.alias(f"{c}__{n}__{k}") for c in self.used for n, d in self._of(c).items() for k, e in d.fit(F.col(f"{c}__x"), F.col(f"{c}__step") if "diff" in self.detectors else F.lit(0.0)).items()]
        self.fitted = rows.groupBy(*self.axis.keys).agg(*aggs) if aggs else None
        return self

    def _with_fitted(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            return df
        return df.join(self.fitted, list(self.axis.keys), "left") if self.axis.keys else df.crossJoin(F.broadcast(self.fitted))  # one row

    def _flagged(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``df`` with the fitted values and a flag ``{c}__{detector}`` for each, and ``{c}__applied``."""
        cols = [c for c in self.used if c in df.columns]
        df = self._with_fitted(df).withColumns({f"{c}__x": self._value(c) for c in cols}) if cols else df
        get = lambda c, n: lambda k: F.col(f"{c}__{n}__{k}")

        def judged(rows: DataFrame, ax: Axis) -> DataFrame:
            stages = [(f"{c}__{n}__", s) for c in cols for n, d in self._of(c).items() for s in enumerate(d.stages(f"{c}__x", ax))]
            for depth in range(1 + max((i for _, (i, _) in stages), default=-1)):
                rows = rows.withColumns({f"{p}{k}": e(p) for p, (i, s) in stages if i == depth for k, e in s.items()})
            flags = {f"{c}__{n}": F.coalesce(F.col(f"{c}__x").isNotNull() & d.flag(f"{c}__x", ax, get(c, n)), F.lit(False)) for c in cols for n, d in self._of(c).items()}
            return rows.withColumns(flags) if flags else rows

        reach = max((d.reach() for c in cols for d in self._of(c).values()), default=0)
        df = chunks.by_rows(df, self.axis, judged, reach, reach) if reach else judged(df, self.axis)
        applied = {f"{c}__applied": F.greatest(F.lit(False), *(F.col(f"{c}__{n}") for n in self._of(c) if n in self.apply or n == "physical"), F.lit(False)) for c in cols}
        return (df.withColumns(applied) if applied else df), cols

    def detect(self, df: DataFrame) -> DataFrame:
        """``df`` with a flag ``{c}__{detector}`` for each column and detector, and ``{c}__applied``."""
        flagged, cols = self._flagged(df)
        return flagged.select(*df.columns, *(f"{c}__{n}" for c in cols for n in (*self._of(c), "applied")))

    def diagnose(self, df: DataFrame) -> DataFrame:
        """Long form, per series: column, detector, count, pct."""
        flagged, cols = self._flagged(df)
        each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(n).alias("detector"), F.count_if(f"{c}__{n}").alias("count"), F.round(100 * F.avg(F.col(f"{c}__{n}").cast("int")), 4).alias("pct")) for c in cols for n in (*self._of(c), "applied")))
        return flagged.groupBy(*self.axis.keys).agg(each.alias("x")).select(*self.axis.keys, F.explode("x").alias("x")).select(*self.axis.keys, "x.*")

    def transform(self, df: DataFrame) -> DataFrame:
        """``flag`` adds ``{c}_outlier`` for every column, so the schema doesn't depend on the data."""
        flagged, cols = self._flagged(df)
        hit = {c: F.col(f"{c}__applied") for c in cols}
        if not cols:
            return df
        if self.action == "drop_rows":
            return flagged.where(~F.greatest(F.lit(False), F.lit(False), *hit.values())).select(df.columns)
        if self.action == "interpolate":
            return interpolated(flagged, self.axis, hit, self.method).select(df.columns)
        if self.action == "set_nan":
            return flagged.withColumns({c: F.when(~h, number(c)) for c, h in hit.items()}).select(df.columns)
        if self.action == "flag":
            return flagged.select(*df.columns, *(h.alias(f"{c}_outlier") for c, h in hit.items()))
        out = {}
        for c, h in hit.items():
            found = [b for n, d in self._of(c).items() if n in self.apply or n == "physical" for b in [d.bounds(lambda k, c=c, n=n: F.col(f"{c}__{n}__{k}"))] if b]
            low = F.greatest(*(b[0] for b in found), F.lit(float("-inf"))) if found else F.lit(float("-inf"))
            high = F.least(*(b[1] for b in found), F.lit(float("inf"))) if found else F.lit(float("inf"))
            clipped = F.greatest(low, F.least(high, number(c)))
            out[c] = F.when(~h, number(c)).when(clipped != number(c), clipped)
        return flagged.withColumns(out).select(df.columns)
