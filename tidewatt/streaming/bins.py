"""Streams of measurements: time bins with a watermark, and runs of missing bins kept as state by series."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, key: str, ts: str, value: str, step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, largest value and count by series and bin. Rows later than ``late`` are dropped by the watermark."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    found = rows.groupBy(F.col(key), F.window(ts, step).alias("w")).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias(ts), "mean", "max", "n")


def gaps(stream: DataFrame, key: str, ts: str, step_us: int) -> DataFrame:
    """``key, start_us, end_us, length``: runs of absent steps between the rows of a series, as they become known.
    The state of a series is its last time; rows that come out of order within a batch are sorted, earlier ones
    than the state are ignored."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def found(name: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        times = sorted(set(int(t) for f in frames for t in f.us))
        out = []
        for t in times:
            if last is not None and t - last > step_us:
                out.append((name[0], last + step_us, t - step_us, (t - last) // step_us - 1))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "start_us", "end_us", "length"])

    return rows.groupBy("key").applyInPandasWithState(found, "key string, start_us long, end_us long, length long", "last long", "append", GroupStateTimeout.NoTimeout)
