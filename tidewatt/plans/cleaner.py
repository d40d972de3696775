"""The cleaning plan, in a fixed order: time axis, exclusions, zeros for missing values, rows of long runs, outliers
by statistics of the training part, fills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axis import Axis
from ..functions.missing import numeric_columns
from ..operators import fills, quality, time_axis
from ..operators.outliers import OutlierProcessor
from ..operators.rules import ColumnRules, build_rules
from ..spec import StationSpec
from .base import Step

KEYS = {"time", "exclude", "missing", "outliers", "interpolation"}


class Cleaner(Step):
    """Clean by a config. Runs are planned anew after long runs are dropped, so what was apart may be neighbours.

    Only columns in ``drop_scope`` (default: all) remove rows. Without a ``detectors`` key only physical limits
    flag outliers; zeros of columns whose rules count them as missing are no outliers."""

    def __init__(self, axis: Axis, config: dict | None = None, limits: dict | None = None, columns: list[str] | None = None, drop_scope: list[str] | None = None):
        self.axis, self.config, self.limits, self.columns, self.drop_scope = axis, config, limits, columns, drop_scope
        if unknown := (config or {}).keys() - KEYS:
            raise ValueError(f"unknown keys {sorted(unknown)}; known: {sorted(KEYS)}")

    @classmethod
    def from_spec(cls, spec, axis: Axis, **overrides) -> "Cleaner":
        spec = StationSpec.load(spec)
        return cls(**({"axis": axis, "config": spec.cleaning, "limits": spec.limits, "drop_scope": spec.used_columns or None} | overrides))

    def _rules(self, df: DataFrame) -> dict[str, ColumnRules]:
        cols = self.columns if self.columns is not None else numeric_columns(df, (*self.axis.keys, self.axis.ts, self.axis.order))
        return build_rules((self.config or {}).get("missing"), [c for c in cols if c in df.columns])

    @property
    def _method(self) -> str:
        return (self.config or {}).get("interpolation", "linear")

    def _exclusions(self) -> list[tuple[Column, list[str] | None]]:
        """Rows and columns to blank; an end without a time is its midnight."""
        out = []
        for item in (self.config or {}).get("exclude") or []:
            if unknown := item.keys() - {"start", "end", "columns"}:
                raise ValueError(f"unknown keys {sorted(unknown)} in an exclusion")
            ts, rows = F.col(self.axis.ts), F.lit(True)
            for key, holds in (("start", lambda v: ts >= v), ("end", lambda v: ts <= v)):
                if item.get(key) is not None:
                    at = item[key] if isinstance(item[key], datetime) else datetime.fromisoformat(str(item[key]))
                    rows = rows & holds(F.lit(at).cast("timestamp_ntz"))
            out.append((rows, item.get("columns")))
        return out

    def _prepared(self, df: DataFrame, rules: dict[str, ColumnRules]) -> DataFrame:
        df = time_axis.prepared(df, self.axis, **((self.config or {}).get("time") or {}))
        for rows, cols in self._exclusions():
            df = df.withColumns({c: F.when(~rows, F.col(c)) for c in cols or rules})
        zeros = [c for c, r in rules.items() if r.nan_to_zero]
        return fills.nan_to_zero(df, zeros) if zeros else df

    def _outliers(self, rules: dict[str, ColumnRules]) -> OutlierProcessor:
        config = dict((self.config or {}).get("outliers") or {})
        if unknown := config.keys() - {"detectors", "apply", "action", "columns"}:
            raise ValueError(f"unknown keys {sorted(unknown)} in outliers")
        return OutlierProcessor(self.axis, config.get("detectors") or {}, config.get("apply"), self.limits, config.get("columns") or list(rules), config.get("action", "interpolate"), [c for c, r in rules.items() if r.zeros], self._method)

    def _fit(self, df: DataFrame) -> None:
        rules = self._rules(df)
        self.outliers_ = self._outliers(rules).fit(fills.dropped_runs(self._prepared(df, rules), self.axis, rules, self.drop_scope))

    def _before_fill(self, df: DataFrame) -> tuple[DataFrame, dict[str, ColumnRules], dict[str, Column]]:
        rules = self._rules(df)
        kept = fills.dropped_runs(self._prepared(df, rules), self.axis, rules, self.drop_scope)
        if self.outliers_.action != "interpolate":
            return self.outliers_.transform(kept), rules, {}
        found = self.outliers_.detect(kept)
        return found, rules, {c: F.col(f"{c}__applied") for c in self.outliers_.used if f"{c}__applied" in found.columns}

    def _transform(self, df: DataFrame) -> DataFrame:
        ready, rules, extra = self._before_fill(df)
        out = fills.filled(ready, self.axis, rules, extra, self._method)
        return out.select([c for c in out.columns if "__" not in c or c in df.columns])

    def plan(self, df: DataFrame) -> dict[str, DataFrame]:
        """Dry run, without ``fit``: runs by rule, and the periods whose rows would go."""
        rules = self._rules(df)
        ready = self._prepared(df, rules)
        return {"runs": fills.plan_table(ready, self.axis, rules), "removed_periods": self._removed(ready, rules)}

    def _removed(self, ready: DataFrame, rules: dict[str, ColumnRules]) -> DataFrame:
        flagged = fills.drop_flags(ready, self.axis, rules, self.drop_scope)
        return quality.removed_periods(flagged, self.axis, F.col("__drop"), {c: F.col(f"{c}__drop") for c in rules if f"{c}__drop" in flagged.columns})

    def _report(self, df: DataFrame) -> dict[str, DataFrame]:
        rules = self._rules(df)
        ready, _, extra = self._before_fill(df)
        prepared = self._prepared(df, rules)
        kept = fills.dropped_runs(prepared, self.axis, rules, self.drop_scope)
        flagged = fills.drop_flags(prepared, self.axis, rules, self.drop_scope)
        counts = df.agg(F.count("*").alias("rows_before")).crossJoin(flagged.agg(F.count_if("__drop").alias("rows_dropped")))  # one row each
        excluded = sum((F.count_if(rows) * len(cols or rules) for rows, cols in self._exclusions()), F.lit(0))
        base = time_axis.prepared(df, self.axis, **((self.config or {}).get("time") or {}))
        counts = counts.crossJoin(base.agg(excluded.cast("long").alias("excluded_values"))).crossJoin(self.transform(df).agg(F.count("*").alias("rows_after")))
        return {
            "time": time_axis.time_report(df, self.axis), "counts": counts, "removed_periods": self._removed(prepared, rules),
            "outliers": self.outliers_.diagnose(kept), "fills": fills.fill_report(ready, self.axis, rules, extra, self._method),
            "remaining": self.transform(df).groupBy(*self.axis.keys).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rules)),
        }
