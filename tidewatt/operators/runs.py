"""Runs: maximal stretches of consecutive rows with one value of a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis


def with_runs(df: DataFrame, axis: Axis, kinds: dict[str, Column]) -> DataFrame:
    """For each name and its kind expression add ``{name}__kind``, ``{name}__start`` (position of the run's first
    row) and ``{name}__len``. A null kind is a kind of its own.

    Starts come from one window forwards and ends from one backwards, whatever the number of columns.
    """
    if axis.chunk:
        cut, inner = chunks.split(df, axis)
        return chunks.joined_runs(with_runs(cut, inner, kinds), axis, inner, list(kinds))
    df = axis.positions(df.withColumns({f"{n}__kind": k for n, k in kinds.items()}))
    ahead, back = axis.window(), axis.reverse()
    edges = {}
    for n in kinds:
        kind = F.col(f"{n}__kind")
        for side, w in (("s", ahead), ("e", back)):
            edges[f"{n}__{side}"] = F.when(F.lag(F.lit(True)).over(w).isNull() | ~kind.eqNullSafe(F.lag(kind).over(w)), F.col("__rn"))
    df = df.withColumns(edges)
    df = df.withColumns({f"{n}__start": F.last(f"{n}__s", ignorenulls=True).over(ahead) for n in kinds})
    df = df.withColumns({f"{n}__end": F.last(f"{n}__e", ignorenulls=True).over(back) for n in kinds})
    lengths = {f"{n}__len": F.col(f"{n}__end") - F.col(f"{n}__start") + 1 for n in kinds}
    return df.withColumns(lengths).drop(*(f"{n}__{x}" for n in kinds for x in ("s", "e", "end")), "__rn")


def runs_of(df: DataFrame, axis: Axis, flag: Column) -> DataFrame:
    """One row per run of true flags: keys, start, end, start_pos, end_pos (from 0) and length."""
    rows = with_runs(df, axis, {"r": F.coalesce(flag, F.lit(False))}).where("r__kind")
    found = rows.groupBy(*axis.keys, "r__start").agg(F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"), F.count("*").alias("length"))
    return found.select(*axis.keys, "start", "end", (F.col("r__start") - 1).alias("start_pos"), (F.col("r__start") + F.col("length") - 2).alias("end_pos"), "length")


def run_lengths(df: DataFrame, axis: Axis, flag: Column, name: str = "run_length") -> DataFrame:
    """Add the length of the run that each row with a true flag is in, else 0."""
    rows = with_runs(df, axis, {"r": F.coalesce(flag, F.lit(False))})
    return rows.withColumn(name, F.when(F.col("r__kind"), F.col("r__len")).otherwise(F.lit(0)).cast("long")).drop("r__kind", "r__start", "r__len")
