"""Profiles of missing values and zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis
from ..functions.missing import is_missing, is_zero, missing_flag, number
from .runs import with_runs


def missing_mask(df: DataFrame, columns, nan: bool = True, zeros: bool = False) -> DataFrame:
    """Columns as flags of missing values and on demand of zeros; others stay."""
    return df.withColumns({c: missing_flag(c, nan, zeros) for c in columns})


def describe_columns(df: DataFrame, columns, keys=()) -> DataFrame:
    """One row per column, from one pass: counts, shares, and statistics of the finite values."""
    def stats(c: str) -> Column:
        v, n = number(c), F.count("*")
        absent = F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))
        pct = lambda x: F.round(100 * F.count_if(x) / n, 4)
        parsed = F.coalesce(F.count(F.col(c).try_cast("double")) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0)) >= 0.8
        return F.struct(
            F.lit(c).alias("column"), n.alias("n"), F.count_if(absent).alias("nan"), pct(absent).alias("nan_pct"), F.count_if(is_zero(c)).alias("zeros"), pct(is_zero(c)).alias("zeros_pct"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), parsed.alias("is_numeric"),
        )

    return df.groupBy(*keys).agg(F.array(*(stats(c) for c in columns)).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")


def _kinds(c: str, nan: bool, zeros: bool, merge: bool) -> Column:
    n, z = is_missing(c) if nan else F.lit(False), is_zero(c) if zeros else F.lit(False)
    if merge:
        return F.when(n | z, F.lit("nan_or_zero" if nan and zeros else "nan" if nan else "zero"))
    return F.when(n, F.lit("nan")).when(z, F.lit("zero"))


def blocks(df: DataFrame, axis: Axis, columns, min_length: int = 1, nan: bool = True, zeros: bool = True, merge: bool = True) -> DataFrame:
    """Runs of at least ``min_length``: column, kind, start, end, length, n_nan, n_zeros."""
    rows = with_runs(df, axis, {c: _kinds(c, nan, zeros, merge) for c in columns})
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__kind").alias("kind"), F.col(f"{c}__start").alias("run"), F.col(f"{c}__len").alias("len"), is_missing(c).alias("nan"), is_zero(c).alias("zero")) for c in columns)))
    rows = rows.select(*axis.keys, axis.ts, each.alias("x")).select(*axis.keys, axis.ts, "x.*").where((F.col("kind").isNotNull()) & (F.col("len") >= min_length))
    found = rows.groupBy(*axis.keys, "column", "kind", "run").agg(F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"), F.count("*").alias("length"), F.count_if("nan").alias("n_nan"), F.count_if("zero").alias("n_zeros"))
    label = F.when(F.col("kind") != "nan_or_zero", F.col("kind")).when((F.col("n_nan") > 0) & (F.col("n_zeros") > 0), "nan+zero").when(F.col("n_nan") > 0, "nan").otherwise("zero")
    return found.select(*axis.keys, "column", label.alias("kind"), "start", "end", "length", "n_nan", "n_zeros")


def run_length_table(df: DataFrame, axis: Axis, columns, nan: bool = True, zeros: bool = True, merge: bool = True) -> DataFrame:
    """How many runs of each length there are: column, kind, length, runs, points."""
    rows = with_runs(df, axis, {c: _kinds(c, nan, zeros, merge) for c in columns})
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__kind").alias("kind"), F.col(f"{c}__len").alias("length")) for c in columns)))
    found = rows.select(*axis.keys, each.alias("x")).select(*axis.keys, "x.*").where("kind IS NOT NULL").groupBy(*axis.keys, "column", "kind", "length").agg(F.count("*").alias("points"))
    return found.select(*axis.keys, "column", "kind", "length", F.expr("points div length").alias("runs"), "points")


def removed_periods(df: DataFrame, axis: Axis, drop: Column, reasons: dict[str, Column]) -> DataFrame:
    """Stretches of dropped rows, with the columns that caused them, in the order of ``reasons``."""
    rows = with_runs(df.withColumns({f"__why_{c}": r for c, r in reasons.items()}), axis, {"r": F.coalesce(drop, F.lit(False))}).where("r__kind")
    why = F.array_join(F.array_compact(F.array(*(F.when(F.bool_or(f"__why_{c}"), F.lit(c)) for c in reasons))), ", ") if reasons else F.lit("")
    return rows.groupBy(*axis.keys, "r__start").agg(F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"), F.count("*").alias("rows"), why.alias("reason")).drop("r__start")


def missing_map(df: DataFrame, axis: Axis, columns, buckets: int = 240, nan: bool = True, zeros: bool = False) -> DataFrame:
    """Share of missing values in slices of equally many rows, each named by its first timestamp."""
    rows = chunks.positions(df, axis)
    if axis.chunk:
        rows = chunks.beside(rows, rows.groupBy(*axis.keys).agg(F.count("*").alias("__n")), axis.keys)
    else:
        rows = rows.withColumn("__n", F.count("*").over(axis.whole()))
    count = F.least(F.lit(max(1, int(buckets))).cast("long"), F.col("__n"))
    rows = rows.withColumn("bucket", F.floor((F.col("__rn") * count - 1) / F.col("__n")).cast("long"))
    shares = [F.avg(missing_flag(c, nan, zeros).cast("double")).alias(c) for c in columns]
    return rows.groupBy(*axis.keys, "bucket").agg(F.min(axis.ts).alias(axis.ts), *shares)


def compare_missing(before: DataFrame, after: DataFrame, columns, nan: bool = True, zeros: bool = True) -> DataFrame:
    """One row per column: counts and shares of missing values in two frames."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(missing_flag(c, nan, zeros)).alias(name), (100 * F.count_if(missing_flag(c, nan, zeros)) / F.count("*")).alias(f"{name}_pct")) for c in columns))
        return df.agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.*")

    return counts(before, "before").join(counts(after, "after"), "column").withColumn("diff_pct", F.col("before_pct") - F.col("after_pct"))
