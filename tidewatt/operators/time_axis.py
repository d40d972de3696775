"""The time axis: order, duplicates, resampling, the regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axis import Axis, micros
from ..functions.missing import number, numeric_columns

DUPLICATES = ("mean", "first", "last", "drop", "keep", "error")


def at_micros(us: Column) -> Column:
    """A timestamp without time zone from microseconds of the epoch."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def deduplicated(df: DataFrame, axis: Axis, how: str = "mean") -> DataFrame:
    """Resolve rows that share a timestamp. The mean is taken of numbers, of other columns the first value that
    is there; ``drop`` removes all rows of such a timestamp, ``error`` raises ValueError."""
    if how not in DUPLICATES:
        raise ValueError(f"duplicates must be one of {DUPLICATES}")
    by, rest = [*axis.keys, axis.ts], [c for c in df.columns if c not in (*axis.keys, axis.ts)]
    if how == "keep":
        return df
    if how == "error":
        if not df.groupBy(*by).count().where("count > 1").isEmpty():
            raise ValueError("duplicate timestamps")
        return df
    if how == "mean":
        numbers = set(numeric_columns(df))
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(axis.order))) if axis.order else F.first(c, ignorenulls=True)
        return df.groupBy(*by).agg(*((F.avg(number(c)) if c in numbers else first(c)).alias(c) for c in rest)).select(df.columns)
    if how == "drop":
        return df.withColumn("__n", F.count("*").over(axis.whole(axis.ts))).where("__n = 1").drop("__n")
    order = F.col(axis.order) if axis.order else F.monotonically_increasing_id()
    rank = F.row_number().over(axis.whole(axis.ts).orderBy(order.desc() if how == "last" else order.asc()))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def infer_freq(df: DataFrame, axis: Axis) -> DataFrame:
    """``freq_us`` of each series: the most frequent positive step between rows; of equals the smallest."""
    step = axis.micros() - F.lag(axis.micros()).over(axis.window())
    steps = df.select(*axis.keys, step.alias("step")).where("step > 0").groupBy(*axis.keys, "step").count()
    return steps.groupBy(*axis.keys).agg(F.max_by("step", F.struct("count", -F.col("step"))).alias("freq_us"))


def frequency(df: DataFrame, axis: Axis) -> int | None:
    """The most frequent step of all series, in microseconds."""
    step = axis.micros() - F.lag(axis.micros()).over(axis.window())
    row = df.select(step.alias("step")).where("step > 0").groupBy("step").count().orderBy(F.desc("count"), "step").first()
    return row and row["step"]


def floor_time(ts: Column, step: int, origin: Column | int = 0) -> Column:
    """Microseconds of the start of a timestamp's bin."""
    us = F.unix_micros(ts.cast("timestamp"))
    return us - F.pmod(us - origin, F.lit(step))


def grid(df: DataFrame, axis: Axis, freq: str | int) -> DataFrame:
    """Keys and timestamps of the regular grid from each series' first to its last row."""
    step = micros(freq)
    ends = df.groupBy(*axis.keys).agg(F.min(axis.micros()).alias("lo"), F.max(axis.micros()).alias("hi")).where("lo IS NOT NULL")
    return ends.select(*axis.keys, F.explode(F.sequence("lo", "hi", F.lit(step))).alias("us")).select(*axis.keys, at_micros(F.col("us")).alias(axis.ts))


def on_grid(df: DataFrame, axis: Axis, freq: str | int) -> DataFrame:
    """The rows of ``df`` and a row for each absent timestamp of the grid; rows off the grid stay."""
    return df.join(grid(df, axis, freq), [*axis.keys, axis.ts], "full").select(df.columns)


def absent_timestamps(df: DataFrame, axis: Axis, freq: str | int) -> DataFrame:
    """Timestamps of the grid without a row."""
    return grid(df, axis, freq).join(df.select(*axis.keys, axis.ts), [*axis.keys, axis.ts], "left_anti")


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}


def resampled(df: DataFrame, axis: Axis, freq: str | int, agg: str = "mean") -> DataFrame:
    """Numeric columns by bins that start at the midnight before the first row; empty bins are there as well."""
    step, numbers = micros(freq), numeric_columns(df, axis.keys)
    day = 86_400_000_000
    if agg not in (*_AGGREGATES, "first", "last"):
        raise ValueError(f"unknown aggregate {agg!r}")
    origin = F.min(axis.micros()).over(axis.whole())
    rows = df.withColumn("__o", origin - F.pmod(origin, F.lit(day))).withColumn("__us", floor_time(F.col(axis.ts), step, F.col("__o")))
    if agg in _AGGREGATES:
        fns = [_AGGREGATES[agg](number(c)).alias(c) for c in numbers]
    else:
        at = F.struct(axis.micros(), *([F.col(axis.order)] if axis.order else []))
        fns = [(F.min_by if agg == "first" else F.max_by)(number(c), F.when(number(c).isNotNull(), at)).alias(c) for c in numbers]
    binned = rows.groupBy(*axis.keys, "__us").agg(*fns).withColumn(axis.ts, at_micros(F.col("__us"))).drop("__us")
    full = on_grid(binned, axis, step)
    if agg in ("sum", "count"):
        full = full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    return full.select(*axis.keys, axis.ts, *numbers)


def prepared(df: DataFrame, axis: Axis, duplicates: str = "mean", freq: str | int | None = None, fill_missing_timestamps: bool = False, resample: str | None = None, agg: str = "mean") -> DataFrame:
    """Duplicates, then resampling, then on demand the grid of ``freq`` or else the most frequent step."""
    df = deduplicated(df, axis, duplicates)
    if resample:
        df = resampled(df, axis, resample, agg)
    if fill_missing_timestamps:
        step = micros(freq) if freq is not None else micros(resample) if resample else frequency(df, axis)
        if step:
            df = on_grid(df, axis, step)
    return df


def time_report(df: DataFrame, axis: Axis, freq: str | int | None = None) -> DataFrame:
    """Per series: rows, duplicate and absent timestamps, and whether rows came in order (by ``axis.order``)."""
    step = micros(freq) if freq is not None else frequency(df, axis) or 1
    came = axis.whole().orderBy(axis.order) if axis.order else axis.window()
    rows = df.withColumn("__sorted", F.coalesce(F.col(axis.ts) >= F.lag(axis.ts).over(came), F.lit(True)))
    found = rows.groupBy(*axis.keys).agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(axis.ts)).alias("duplicates"), F.every("__sorted").alias("was_sorted"), F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"))
    absent = absent_timestamps(df, axis, step).groupBy(*axis.keys).agg(F.count("*").alias("missing_timestamps"))
    joined = found.join(absent, list(axis.keys), "left") if axis.keys else found.join(absent, F.lit(True), "left")
    return joined.withColumn("missing_timestamps", F.coalesce("missing_timestamps", F.lit(0)))
