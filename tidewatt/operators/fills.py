"""Planning and filling of missing runs.

A kept zero is a known neighbour for interpolation, a kept missing value is not. Interpolation goes by row
position (``linear``) or by time, only between known values; what it cannot reach becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis
from ..functions.missing import is_missing, is_zero, number
from .rules import ColumnRules
from .runs import with_runs


def prepared(c: str, rules: ColumnRules) -> Column:
    """A column as finite doubles; with ``nan_to_zero`` what is missing is 0."""
    return F.coalesce(number(c), F.lit(0.0)) if rules.nan_to_zero else number(c)


def _kind(c: str, r: ColumnRules) -> Column:
    value = prepared(c, r)
    nan, zero = is_missing(value) if r.nan else F.lit(False), is_zero(value) if r.zeros else F.lit(False)
    if r.merge:
        return F.when(nan | zero, F.lit("missing"))
    return F.when(nan, F.lit("nan")).when(zero, F.lit("zero"))


def planned(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules]) -> DataFrame:
    """Add ``{c}__kind``, ``{c}__start``, ``{c}__len`` and ``{c}__action`` for each column with rules."""
    rules = {c: r for c, r in rules.items() if c in df.columns}
    df = with_runs(df, axis, {c: _kind(c, r) for c, r in rules.items()})
    return df.withColumns({f"{c}__action": r.action(F.col(f"{c}__kind"), F.col(f"{c}__len")) for c, r in rules.items()})


def _unplanned(df: DataFrame, rules) -> DataFrame:
    return df.drop(*(f"{c}__{x}" for c in rules for x in ("kind", "start", "len", "action")))


def plan_table(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules]) -> DataFrame:
    """Dry run: ``column, kind, length, action, runs, points`` for each rule that holds somewhere."""
    rows = planned(df, axis, rules)
    each = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__kind").alias("kind"), r.rule(F.col(f"{c}__kind"), F.col(f"{c}__len")).alias("length"), F.col(f"{c}__action").alias("action"), (1 / F.col(f"{c}__len")).alias("part"))
        for c, r in rules.items() if c in df.columns)))
    found = rows.select(*axis.keys, each.alias("x")).select(*axis.keys, "x.*").where("kind IS NOT NULL")
    return found.groupBy(*axis.keys, "column", "kind", "length", "action").agg(F.round(F.sum("part")).cast("long").alias("runs"), F.count("*").alias("points"))


def drop_flags(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules], scope=None) -> DataFrame:
    """Add ``__drop`` and, for each column in scope, ``{c}__drop``."""
    scoped = {c: r for c, r in rules.items() if (scope is None or c in scope) and c in df.columns and r.can("drop_rows")}
    if not scoped:
        return df.withColumn("__drop", F.lit(False))
    marked = planned(df, axis, scoped).withColumns({f"{c}__drop": F.coalesce(F.col(f"{c}__action") == "drop_rows", F.lit(False)) for c in scoped})
    return _unplanned(marked, scoped).withColumn("__drop", F.greatest(*(F.col(f"{c}__drop") for c in scoped), F.lit(False)))


def dropped_runs(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules], scope=None) -> DataFrame:
    """Rows outside the ``drop_rows`` runs of the columns in scope (default: all with rules)."""
    flagged = drop_flags(df, axis, rules, scope)
    return flagged.where("NOT __drop").select(df.columns)


def interpolated(df: DataFrame, axis: Axis, positions: dict[str, Column], method: str = "linear") -> DataFrame:
    """Replace the values at ``positions`` by interpolation between the nearest known values."""
    at = axis.micros() if method == "time" else F.col("__rn")
    df = chunks.positions(df, axis).withColumn("__at", at)
    df = df.withColumns({f"{c}__pos": F.coalesce(p, F.lit(False)) for c, p in positions.items()})
    known = {c: F.when(~F.col(f"{c}__pos"), number(c)) for c in positions}
    point = {c: F.when(k.isNotNull(), F.struct(k.alias("v"), F.col("__at").alias("at"))) for c, k in known.items()}
    df = chunks.known(df, axis, {f"{c}__prev": p for c, p in point.items()}, {f"{c}__next": p for c, p in point.items()})

    def between(c: str) -> Column:
        p, n = F.col(f"{c}__prev"), F.col(f"{c}__next")
        return p["v"] + (n["v"] - p["v"]) * (F.col("__at") - p["at"]) / F.nullif(n["at"] - p["at"], F.lit(0))

    df = df.withColumns({c: F.when(F.col(f"{c}__pos"), between(c)).otherwise(number(c)) for c in positions})
    return df.drop("__rn", "__at", *(f"{c}__{x}" for c in positions for x in ("pos", "prev", "next")))


def carried(df: DataFrame, axis: Axis, positions: dict[str, Column], backwards: bool = False) -> DataFrame:
    """Replace the values at ``positions`` by the last known value before them, or the next one after."""
    values = {f"{c}__near": F.when(~F.coalesce(p, F.lit(False)), number(c)) for c, p in positions.items()}
    df = chunks.known(df, axis, **{"back" if backwards else "ahead": values})
    return df.withColumns({c: F.when(p, F.col(f"{c}__near")).otherwise(number(c)) for c, p in positions.items()}).drop(*values)


def filled(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules], extra: dict[str, Column] | None = None, method: str = "linear", keep_plan: bool = False) -> DataFrame:
    """Apply the fills in their fixed order: interpolate, zeros, forwards, backwards, null. Later fills see what
    earlier ones made. ``extra`` flags further positions to interpolate. Steps that no rule asks for are left out."""
    rules = {c: r for c, r in rules.items() if c in df.columns}
    extra, before = extra or {}, df.columns
    df = planned(df, axis, rules).withColumns({c: prepared(c, r) for c, r in rules.items()})
    if keep_plan:
        df = df.withColumns({f"{c}__before": F.col(c) for c in rules})

    def at(c: str, action: str) -> Column:
        return F.coalesce(F.col(f"{c}__action") == action, F.lit(False))

    steps = {a: [c for c, r in rules.items() if r.can(a)] for a in ("interpolate", "fill_zero", "ffill", "bfill", "set_nan")}
    if spots := {c: at(c, "interpolate") | extra[c] if c in extra else at(c, "interpolate") for c in rules if c in extra or c in steps["interpolate"]}:
        df = interpolated(df, axis, spots, method)
    if steps["fill_zero"]:
        df = df.withColumns({c: F.when(at(c, "fill_zero"), 0.0).otherwise(F.col(c)) for c in steps["fill_zero"]})
    for action in ("ffill", "bfill"):
        if steps[action]:
            df = carried(df, axis, {c: at(c, action) for c in steps[action]}, action == "bfill")
    if steps["set_nan"]:
        df = df.withColumns({c: F.when(~at(c, "set_nan"), F.col(c)) for c in steps["set_nan"]})
    return df if keep_plan else df.select(before)


def fill_report(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules], extra: dict[str, Column] | None = None, method: str = "linear") -> DataFrame:
    """One row per series and column: what was missing, what each fill did, and what is still missing."""
    rules = {c: r for c, r in rules.items() if c in df.columns}
    extra = extra or {}
    done = filled(df.withColumns({f"{c}__extra": e for c, e in extra.items()}), axis, rules, {c: F.col(f"{c}__extra") for c in extra}, method, keep_plan=True)
    n = lambda cond: F.count_if(cond)
    rows = []
    for c, r in rules.items():
        action, out = F.col(f"{c}__action"), F.col(c)
        outlier = F.coalesce(F.col(f"{c}__extra"), F.lit(False)) if c in extra else F.lit(False)
        spot = F.coalesce(action == "interpolate", F.lit(False)) | outlier
        after = (out.isNull() if r.nan else F.lit(False)) | (F.coalesce(out == 0, F.lit(False)) if r.zeros else F.lit(False))
        before = F.col(f"{c}__kind").isNotNull()
        rows.append(F.struct(
            F.lit(c).alias("column"), n(before).alias("missing_before"), F.count_distinct(F.when(before, F.col(f"{c}__start"))).alias("runs"), n(action == "keep").alias("kept"),
            n(outlier).alias("outliers_interpolated"), n(spot & out.isNotNull()).alias("interpolated"), n(spot & out.isNull()).alias("interpolation_failed"),
            *(n(action == a).alias(a) for a in ("fill_zero", "ffill", "bfill", "set_nan")), n(after).alias("missing_after"),
            F.round(100 * n(before) / F.count("*"), 4).alias("missing_before_pct"), F.round(100 * n(after) / F.count("*"), 4).alias("missing_after_pct"),
        ))
    return done.groupBy(*axis.keys).agg(F.array(*rows).alias("x")).select(*axis.keys, F.explode("x").alias("x")).select(*axis.keys, "x.*")


def run_rules(columns, runs, **options) -> dict[str, ColumnRules]:
    return {c: ColumnRules.of({"runs": runs} | options) for c in columns}


def delete_large_gaps(df: DataFrame, axis: Axis, columns, min_gap: int = 25, zeros: bool = False, merge: bool = True) -> DataFrame:
    """Drop the rows of runs of at least ``min_gap``."""
    return dropped_runs(df, axis, run_rules(columns, {"drop_rows": [min_gap, None]}, zeros=zeros, merge=merge))


def linear_interpolation(df: DataFrame, axis: Axis, columns, max_gap: int = 3, min_gap: int = 1, zeros: bool = False, merge: bool = True, method: str = "linear") -> DataFrame:
    """Interpolate runs of ``min_gap`` to ``max_gap``."""
    return filled(df, axis, run_rules(columns, {"interpolate": [min_gap, max_gap]}, zeros=zeros, merge=merge), method=method)


def forward_fill(df: DataFrame, axis: Axis, columns, max_gap: int = 2, zeros: bool = False) -> DataFrame:
    """Carry values into runs of at most ``max_gap``."""
    return filled(df, axis, run_rules(columns, {"ffill": [1, max_gap]}, zeros=zeros))


def process_missing(df: DataFrame, axis: Axis, rules: dict[str, ColumnRules], drop_scope=None, method: str = "linear") -> DataFrame:
    """Drop the rows of long runs, then plan anew on what is left and fill."""
    return filled(dropped_runs(df, axis, rules, drop_scope), axis, rules, method=method)


def nan_to_zero(df: DataFrame, columns) -> DataFrame:
    """Null and NaN become 0; infinities stay."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns})


def median_imputed(df: DataFrame, train: DataFrame, axis: Axis, columns, groupby=()) -> DataFrame:
    """Fill missing values with the median of their group in ``train``, else with the median of all of it.
    Groups are columns or calendar features."""
    from ..functions.calendar import calendar_value

    keys = {f"__g{i}": F.col(g) if g in train.columns else calendar_value(axis.ts, g) for i, g in enumerate(groupby)}
    overall = train.groupBy(*axis.keys).agg(*(F.median(number(c)).alias(f"__{c}_all") for c in columns))
    out = df.join(overall, list(axis.keys), "left") if axis.keys else df.crossJoin(F.broadcast(overall))  # one row
    if keys:
        groups = train.withColumns(keys).groupBy(*axis.keys, *keys).agg(*(F.median(number(c)).alias(f"__{c}_group") for c in columns))
        out = out.withColumns(keys).join(groups, [*axis.keys, *keys], "left")
    value = lambda c: F.coalesce(number(c), *([F.col(f"__{c}_group")] if keys else []), F.col(f"__{c}_all"))
    return out.withColumns({c: value(c) for c in columns}).select(df.columns)
