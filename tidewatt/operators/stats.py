"""Correlations, autocorrelation, spectrum and distributions."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import chunks
from ..axis import Axis
from ..functions.calendar import wind_sector
from ..functions.missing import number
from .fills import interpolated
from .time_axis import frequency

METHODS = ("pearson", "spearman", "kendall")


def _pairs(columns) -> list[tuple[str, str]]:
    return list(itertools.combinations(columns, 2))


def _long(df: DataFrame, columns, keys) -> DataFrame:
    """A row for each pair of columns where both have values."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number(a).alias("x"), number(b).alias("y")) for a, b in _pairs(columns))))
    return df.select(*keys, each.alias("p")).select(*keys, "p.*").where("x IS NOT NULL AND y IS NOT NULL")


def _rank(value: str, by: list[str]) -> Column:
    """Average rank; the ties are counted over the same order."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(a: Column, b: Column) -> Column:
    """Spark's own ``corr`` raises an error where one side is constant; this is null there."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def correlation(df: DataFrame, columns, method: str = "pearson", keys=()) -> DataFrame:
    """``a, b, r, n`` for each pair of columns, over the rows where both have values.

    Kendall's tau-b is counted over pairs of values of a series, in a grouped function that sorts them by
    merging; it holds one pair of columns of one series at a time.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "pearson":
        found = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.when(number(b).isNotNull(), number(a)), F.when(number(a).isNotNull(), number(b))).alias("r"), F.count_if(number(a).isNotNull() & number(b).isNotNull()).alias("n")) for a, b in _pairs(columns)))
        return df.groupBy(*keys).agg(found.alias("p")).select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")
    by = [*keys, "a", "b"]
    rows = _long(df, columns, keys)
    if method == "spearman":
        ranked = rows.withColumns({"rx": _rank("x", by), "ry": _rank("y", by)})
        return ranked.groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("r"), F.count("*").alias("n"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds + ', ' if kinds else ''}a string, b string, r double, n long"

    def tau(key, pdf):
        import pandas as pd

        return pd.DataFrame([[*key, kendall(pdf.x.to_numpy(), pdf.y.to_numpy()), len(pdf)]], columns=[*by, "r", "n"])

    return rows.groupBy(*by).applyInPandas(tau, schema)


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b in n log n: discordant pairs are the inversions of y in the order of x."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def ties(*cols: np.ndarray) -> int:
        change = np.any([np.diff(c) != 0 for c in cols], axis=0)
        counts = np.diff(np.concatenate([[0], np.flatnonzero(change) + 1, [n]]))
        return int((counts * (counts - 1) // 2).sum())

    if n < 2:
        return float("nan")
    ranks, width, swaps = np.unique(y, return_inverse=True)[1], 1, 0
    while width < n:  # bottom-up merge sort, counting
        for a in range(0, n - width, 2 * width):
            left, right = ranks[a : a + width], ranks[a + width : a + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            ranks[a : a + 2 * width] = np.sort(ranks[a : a + 2 * width], kind="stable")
        width *= 2
    total, tx, ty, txy = n * (n - 1) // 2, ties(x), ties(np.sort(y)), ties(x, y)
    below = np.sqrt(float(total - tx)) * np.sqrt(float(total - ty))
    return (total - tx - ty + txy - 2 * swaps) / below if below else float("nan")


def pair_counts(df: DataFrame, columns, keys=()) -> DataFrame:
    """``a, b, n``: rows where both have values."""
    return correlation(df, columns, "pearson", keys).select(*keys, "a", "b", "n")


def target_correlation(df: DataFrame, columns, target: str, method: str = "pearson", keys=()) -> DataFrame:
    """``column, r`` of each column with the target, strongest first."""
    rows = correlation(df, [target, *(c for c in columns if c != target)], method, keys).where((F.col("a") == target) | (F.col("b") == target))
    return rows.select(*keys, F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("column"), "r").orderBy(*keys, F.abs("r").desc(), "column")


def gapless(df: DataFrame, axis: Axis, c: str) -> DataFrame:
    """Keys, position and ``v``: a column interpolated by position, with the nearest value at the edges, less its mean."""
    rows = interpolated(df.select(*axis.keys, axis.ts, F.col(c).alias("v")), axis, {"v": number("v").isNull()})
    rows = chunks.known(rows, axis, {"__before": F.col("v")}, {"__after": F.col("v")})
    rows = chunks.positions(rows.withColumn("v", F.coalesce("v", "__before", "__after")).drop("__before", "__after"), axis)
    if axis.chunk:
        rows = chunks.beside(rows, rows.groupBy(*axis.keys).agg(F.avg("v").alias("__mean")), axis.keys)
        return rows.select(*axis.keys, axis.ts, "__rn", (F.col("v") - F.col("__mean")).alias("v"))
    return rows.select(*axis.keys, axis.ts, "__rn", (F.col("v") - F.avg("v").over(axis.whole())).alias("v"))


def acf(df: DataFrame, axis: Axis, c: str, max_lag: int = 168) -> DataFrame:
    """``lag, acf`` for lags in rows from 0. The lagged values come from one pass over windows of the series."""
    rows = gapless(df, axis, c)
    lagged = chunks.by_rows(rows, axis, lambda r, ax: r.withColumns({f"v{k}": F.lag("v", k).over(ax.window()) for k in range(max_lag + 1)}), max_lag)
    # One row for each series, with a sum for each lag, is what gets unfolded.
    sums = lagged.groupBy(*axis.keys).agg(F.count("*").alias("n"), F.array(*(F.coalesce(F.sum(F.col("v") * F.col(f"v{k}")), F.lit(0.0)) for k in range(max_lag + 1))).alias("p"))
    found = sums.select(*axis.keys, "n", F.col("p")[0].alias("q"), F.posexplode("p").alias("lag", "p")).where("lag < n")
    return found.select(*axis.keys, "lag", F.when(F.col("q") > 0, F.col("p") / F.col("q")).otherwise(0.0).alias("acf"))


def spectrum(df: DataFrame, axis: Axis, c: str) -> DataFrame:
    """Periodogram of each series: frequency, period_steps, period_hours, power. Spark has no Fourier transform, so
    a grouped function takes one series at a time."""
    hours = (frequency(df, axis) or 0) / 3.6e9 or float("nan")
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in axis.keys)

    def transform(key, pdf):
        import pandas as pd

        v = pdf.sort_values("__rn").v.to_numpy()
        f = np.fft.rfftfreq(len(v))[1:]
        out = pd.DataFrame({"frequency": f, "period_steps": 1 / f, "period_hours": hours / f, "power": (np.abs(np.fft.rfft(v)) ** 2)[1:]})
        for i, k in enumerate(axis.keys):
            out.insert(i, k, key[i])
        return out

    schema = f"{kinds + ', ' if kinds else ''}frequency double, period_steps double, period_hours double, power double"
    rows = gapless(df, axis, c).drop(axis.ts).withColumn("__all", F.lit(0))
    return rows.groupBy(*(axis.keys or ["__all"])).applyInPandas(transform, schema)


def histogram(df: DataFrame, c: str, bins: int = 50, keys=()) -> DataFrame:
    """``bin, low, high, n`` over equal bins from the smallest to the largest value, which is in the last bin."""
    ends = df.groupBy(*keys).agg(F.min(number(c)).alias("lo"), F.max(number(c)).alias("hi"))
    rows = df.select(*keys, number(c).alias("v")).where("v IS NOT NULL")
    rows = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.when(step == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)))
    return rows.groupBy(*keys, place.cast("long").alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def box(df: DataFrame, columns, keys=()) -> DataFrame:
    """``column, low, q1, median, q3, high``."""
    def five(c: str) -> Column:
        q = F.percentile(number(c), F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
        return F.struct(F.lit(c).alias("column"), *(q[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))

    return df.groupBy(*keys).agg(F.array(*map(five, columns)).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")


def wind_rose(df: DataFrame, speed: str, direction: str, sectors: int = 16, speed_bins=None, keys=()) -> DataFrame:
    """``sector, speed_class, n, share`` (in percent of the rows with both values). Classes lie between the edges
    ``speed_bins``, by default the quartiles; the last one includes its upper edge."""
    rows = df.select(*keys, number(speed).alias("v"), number(direction).alias("d")).where("v IS NOT NULL AND d IS NOT NULL")
    edges = speed_bins or list(rows.agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))).first()[0] or [0.0, 1.0])
    cls = sum((F.when(F.col("v") >= b, 1).otherwise(0) for b in edges[1:-1]), F.lit(0)).cast("int")
    cls = F.when(F.col("v").between(edges[0], edges[-1]), cls)
    found = rows.groupBy(*keys, wind_sector(F.pmod(F.col("d"), F.lit(360.0)), sectors).alias("sector"), cls.alias("speed_class")).agg(F.count("*").alias("n"))
    return found.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).where("speed_class IS NOT NULL")
