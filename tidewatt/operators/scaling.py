"""Scaling of features and transformation of the target; parameters come from one aggregate of a training frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import number, numeric_columns
from ..functions.special import logistic, logit

METHODS = ("standard", "minmax", "robust", "maxabs")


@dataclass
class Scaler:
    """(x - centre) / spread, stretched to ``feature_range`` for minmax. A spread of zero counts as 1. Statistics
    are of the finite values; ``scale`` fixes the spread of maxabs."""

    method: str = "standard"
    columns: list[str] | None = None
    exclude: tuple[str, ...] = ()
    feature_range: tuple[float, float] = (0.0, 1.0)
    scale: float | None = None
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.scale is not None and self.method != "maxabs":
            raise ValueError("scale is for maxabs")

    def fit(self, df: DataFrame) -> "Scaler":
        cols = [c for c in (self.columns if self.columns is not None else numeric_columns(df)) if c not in self.exclude]
        if self.scale is not None:
            self.params = {c: (0.0, float(self.scale)) for c in cols}
            return self
        def stats(v: Column) -> tuple[Column, Column]:
            q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            return {"standard": (F.avg(v), F.stddev_pop(v)), "minmax": (F.min(v), F.max(v) - F.min(v)), "robust": (q[1], q[2] - q[0]), "maxabs": (F.lit(0.0), F.max(F.abs(v)))}[self.method]

        row = df.agg(*(e.alias(f"{c}__{i}") for c in cols for i, e in enumerate(stats(number(c))))).first() if cols else {}
        self.params = {c: (row[f"{c}__0"] if row[f"{c}__0"] is not None else 0.0, row[f"{c}__1"] or 1.0) for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        lo, hi = self.feature_range if self.method == "minmax" else (0.0, 1.0)
        return df.withColumns({c: (F.col(c) - m) / s * (hi - lo) + lo for c, (m, s) in self.params.items() if c in df.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        lo, hi = self.feature_range if self.method == "minmax" else (0.0, 1.0)
        return df.withColumns({c: (F.col(c) - lo) / (hi - lo) * s + m for c, (m, s) in self.params.items() if c in df.columns})


@dataclass
class TargetTransform:
    """The target as it is (``identity``), over its range (``minmax``; ``eps`` widens the range), or the clipped
    logit of that (``minmax_logit``; ``eps`` keeps the share off 0 and 1, ``denom_eps`` widens the range)."""

    kind: str = "identity"
    eps: float | None = None
    clip: float = 10.0
    denom_eps: float = 1e-6
    low: float = 0.0
    spread: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in ("identity", "minmax", "minmax_logit"):
            raise ValueError(f"unknown target transform {self.kind!r}")
        if self.eps is None:
            self.eps = 1e-6 if self.kind == "minmax_logit" else 0.0

    def fit(self, df: DataFrame, target: str) -> "TargetTransform":
        if self.kind != "identity":
            lo, hi = df.agg(F.min(number(target)), F.max(number(target))).first()
            if lo is None:
                raise ValueError("the target has no values")
            self.low, self.spread = lo, (hi - lo + (self.denom_eps if self.kind == "minmax_logit" else self.eps)) or 1.0
        return self

    def transform(self, y: Column) -> Column:
        if self.kind == "identity":
            return y
        share = (y - self.low) / self.spread
        if self.kind == "minmax":
            return share
        inside = lambda x, lo, hi: F.when(y.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
        return inside(logit(inside(share, self.eps, 1 - self.eps)), -self.clip, self.clip)

    def inverse_transform(self, z: Column) -> Column:
        if self.kind == "identity":
            return z
        return (logistic(z) if self.kind == "minmax_logit" else z) * self.spread + self.low
