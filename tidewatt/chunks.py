"""Series that are longer than a task: an axis with a ``chunk`` cuts them in stretches of time.

Windows then run within chunks, and what crosses their bounds comes from a small table with a row for each chunk
(known values, positions and runs) or from rows that are dealt to the neighbouring chunk too (bounded frames). Each
pass that needs the small table writes its rows once, so that nothing is computed twice. Results equal those of an
axis without chunks; rows without a time are one chunk, before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .axis import Axis, micros

#: Rows of a block of bounded frames; blocks are longer where the frames are.
BLOCK = 1 << 16


def split(df: DataFrame, axis: Axis) -> tuple[DataFrame, Axis]:
    """``df`` with its ``__chunk``, and an axis whose series are the chunks."""
    part = F.floor(axis.micros() / F.lit(micros(axis.chunk)))
    return df.withColumn("__chunk", F.coalesce(part, F.lit(-(2**62)))), replace(axis, keys=(*axis.keys, "__chunk"), chunk=None)


def beside(rows: DataFrame, table: DataFrame, on: Iterable[str]) -> DataFrame:
    """``rows`` with the columns of a table that has one row for each value of ``on``, nulls included."""
    on = list(on)
    named = table.withColumnsRenamed({c: f"__of_{c}" for c in on})
    return rows.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on), F.lit(True)), "left").drop(*(f"__of_{c}" for c in on))


def _across(axis: Axis, reverse: bool = False):
    """The chunks of a series in the order of time, or against it."""
    return Window.partitionBy(*axis.keys).orderBy(F.desc("__chunk") if reverse else F.asc("__chunk"))


def positions(df: DataFrame, axis: Axis, name: str = "__rn") -> DataFrame:
    """Number the rows of each series from 1."""
    if not axis.chunk:
        return axis.positions(df, name)
    cut, inner = split(df, axis)
    cut = scratch.written(inner.positions(cut, name), "positions")
    before = cut.groupBy(*inner.keys).count().select(*inner.keys, (F.sum("count").over(_across(axis)) - F.col("count")).alias("__before"))
    return beside(cut, before, inner.keys).withColumn(name, F.col(name) + F.col("__before")).drop("__before", "__chunk")


def known(df: DataFrame, axis: Axis, ahead: dict[str, Column] | None = None, back: dict[str, Column] | None = None) -> DataFrame:
    """Add the last value that isn't null up to each row (``ahead``), and the first one from it on (``back``)."""
    sides = [(v, reverse) for v, reverse in ((ahead or {}, False), (back or {}, True)) if v]
    cut, inner = split(df, axis) if axis.chunk else (df, axis)
    for values, reverse in sides:
        w = inner.reverse() if reverse else inner.window()
        cut = cut.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()} | ({f"__at{reverse}": F.row_number().over(w)} if axis.chunk else {}))
    if not axis.chunk or not sides:
        return cut.drop("__chunk") if axis.chunk else cut
    rows = scratch.written(cut, "known")
    ends = rows.groupBy(*inner.keys).agg(*(F.max_by(n, f"__at{r}").alias(n) for values, r in sides for n in values))
    ends = ends.select(*inner.keys, *(F.last(n, ignorenulls=True).over(_across(axis, r).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__far_{n}") for values, r in sides for n in values))
    names = [n for values, _ in sides for n in values]
    full = beside(rows, ends, inner.keys).withColumns({n: F.coalesce(n, f"__far_{n}") for n in names})
    return full.drop("__chunk", *(f"__at{r}" for _, r in sides), *(f"__far_{n}" for n in names))


def joined_runs(cut: DataFrame, axis: Axis, inner: Axis, names: list[str]) -> DataFrame:
    """Runs within chunks (``{n}__kind``, ``{n}__start``, ``{n}__len``, counted within the chunk) as runs of the series."""
    rows = scratch.written(inner.positions(cut, "__i"), "runs")
    edge = {f"{n}__{k}": f(F.col(f"{n}__{c}"), F.col("__i")) for n in names for k, f, c in (("k0", F.min_by, "kind"), ("l0", F.min_by, "len"), ("k1", F.max_by, "kind"), ("s1", F.max_by, "start"))}
    ends = rows.groupBy(*inner.keys).agg(F.count("*").alias("__n"), *(e.alias(a) for a, e in edge.items()))
    ahead, behind = _across(axis), _across(axis, True)
    ends = ends.withColumns({"__before": F.sum("__n").over(ahead) - F.col("__n")} | {f"{n}__from": F.lag(F.lit(True)).over(ahead).isNotNull() & F.col(f"{n}__k0").eqNullSafe(F.lag(f"{n}__k1").over(ahead)) for n in names} | {f"{n}__on": F.lag(F.lit(True)).over(behind).isNotNull() & F.col(f"{n}__k1").eqNullSafe(F.lag(f"{n}__k0").over(behind)) for n in names})
    # The start of a chunk's last run and the end of its first, where they lie in the chunk; else those of a neighbour.
    ends = ends.withColumns({f"{n}__a": F.when(~((F.col(f"{n}__s1") == 1) & F.col(f"{n}__from")), F.col("__before") + F.col(f"{n}__s1")) for n in names} | {f"{n}__z": F.when(~((F.col(f"{n}__l0") == F.col("__n")) & F.col(f"{n}__on")), F.col("__before") + F.col(f"{n}__l0")) for n in names})
    past = Window.unboundedPreceding
    ends = ends.withColumns({f"{n}__a": F.last(f"{n}__a", ignorenulls=True).over(ahead.rowsBetween(past, -1)) for n in names} | {f"{n}__z": F.last(f"{n}__z", ignorenulls=True).over(behind.rowsBetween(past, -1)) for n in names})
    full = beside(rows, ends.select(*inner.keys, "__n", "__before", *(f"{n}__{x}" for n in names for x in ("from", "on", "a", "z"))), inner.keys)
    last = {n: F.col(f"{n}__start") + F.col(f"{n}__len") - 1 for n in names}
    starts = {n: F.when((F.col(f"{n}__start") == 1) & F.col(f"{n}__from"), F.col(f"{n}__a")).otherwise(F.col("__before") + F.col(f"{n}__start")) for n in names}
    stops = {n: F.when((last[n] == F.col("__n")) & F.col(f"{n}__on"), F.col(f"{n}__z")).otherwise(F.col("__before") + last[n]) for n in names}
    full = full.withColumns({f"{n}__{x}": e for n in names for x, e in (("start", starts[n]), ("len", stops[n] - starts[n] + 1))})
    return full.drop("__i", "__n", "__before", "__chunk", *(f"{n}__{x}" for n in names for x in ("from", "on", "a", "z")))


def by_rows(df: DataFrame, axis: Axis, fn: Callable[[DataFrame, Axis], DataFrame], before: int, after: int = 0) -> DataFrame:
    """``fn`` of a frame whose columns at a row depend on at most so many rows before and after it, by blocks of rows
    that hold those of their neighbours too. ``fn`` keeps all columns."""
    if not axis.chunk:
        return fn(df, axis)
    size = max(BLOCK, 4 * (before + after))
    at = F.pmod(F.col("__place") - 1, F.lit(size))
    rows = positions(df, axis, "__place").withColumn("__own", F.expr(f"(__place - 1) div {size}"))
    return _dealt(rows, axis, fn, F.when(at < after, F.col("__own") - 1), F.when(at >= size - before, F.col("__own") + 1)).drop("__place")


def by_time(df: DataFrame, axis: Axis, fn: Callable[[DataFrame, Axis], DataFrame], before: int) -> DataFrame:
    """The same for columns that depend on the rows of the last ``before`` microseconds."""
    if not axis.chunk:
        return fn(df, axis)
    size = max(micros(axis.chunk), before)
    rows = split(df, replace(axis, chunk=size))[0].withColumnRenamed("__chunk", "__own")
    return _dealt(rows, axis, fn, F.when(F.pmod(axis.micros(), F.lit(size)) >= size - before, F.col("__own") + 1))


def _dealt(rows: DataFrame, axis: Axis, fn, *others: Column) -> DataFrame:
    rows = rows.withColumn("__chunk", F.explode(F.array_compact(F.array("__own", *others))))
    return fn(rows, replace(axis, keys=(*axis.keys, "__chunk"), chunk=None)).where("__chunk = __own").drop("__chunk", "__own")
