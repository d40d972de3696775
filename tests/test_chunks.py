"""Series cut in chunks of time give the same results as whole ones."""

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatt import chunks
from tidewatt.axis import Axis
from tidewatt.functions.missing import is_missing
from tidewatt.operators import features, fills, outliers, quality, runs, stats
from tidewatt.operators.rules import ColumnRules

KEYED, ALONE = Axis("ts", ("s",)), Axis("ts")
RULES = {"v": ColumnRules.of({"zeros": True, "merge": False, "runs": {"interpolate": [1, 3], "ffill": [4, 6], "bfill": [7, 12], "drop_rows": [13, None]}})}


@pytest.fixture(scope="module")
def rough(spark):
    """Two series and one without a name; runs of nulls and zeros, some longer than several chunks, and a stretch without rows."""
    rng, rows = np.random.default_rng(5), []
    for s in ("a", "b", None):
        v = rng.normal(10, 3, 400)
        v[rng.random(400) < 0.15] = np.nan
        v[rng.random(400) < 0.1] = 0
        v[100:160], v[200:204], v[300:309], v[395:] = np.nan, 0, np.nan, np.nan
        v[250] = 500
        rows += [(s, datetime(2024, 1, 1) + timedelta(hours=i), None if np.isnan(x) else float(x)) for i, x in enumerate(v) if not 170 <= i < 195]
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")


def rows_of(df):
    cols = sorted(df.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


CASES = {
    "positions": lambda d, ax: chunks.positions(d, ax),
    "runs": lambda d, ax: runs.runs_of(d, ax, is_missing("v")),
    "run_lengths": lambda d, ax: runs.run_lengths(d, ax, is_missing("v")),
    "blocks": lambda d, ax: quality.blocks(d, ax, ["v"]),
    "map": lambda d, ax: quality.missing_map(d, ax, ["v"], 30),
    "plan": lambda d, ax: fills.plan_table(d, ax, RULES),
    "linear": lambda d, ax: fills.interpolated(d, ax, {"v": is_missing("v")}),
    "time": lambda d, ax: fills.interpolated(d, ax, {"v": is_missing("v")}, "time"),
    "missing": lambda d, ax: fills.process_missing(d, ax, RULES),
    "detectors": lambda d, ax: outliers.OutlierProcessor(ax, {"hampel": {"window": 12, "min_periods": 3}, "rolling_median": {"window": 7}, "diff": {}}, columns=["v"]).fit(d).detect(d),
    "lags": lambda d, ax: features.lag_features(d, ax, ["v"], [1, 24], "1h"),
    "rolling": lambda d, ax: features.rolling_features(d, ax, ["v"], [3, 30], ("mean", "max"), "1h"),
    "windows": lambda d, ax: features.make_windows(d, ax, ["v"], 4, "1h"),
    "acf": lambda d, ax: stats.acf(d, ax, "v", 30),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_chunks_change_nothing(rough, monkeypatch, case):
    monkeypatch.setattr(chunks, "BLOCK", 40)
    for df, ax in ((rough, KEYED), (rough.where("s = 'a'").drop("s"), ALONE)):
        whole = rows_of(CASES[case](df, ax))
        assert whole
        assert rows_of(CASES[case](df, replace(ax, chunk="17h"))) == whole


def test_rows_without_a_time_come_first(rough):
    df = rough.where("s = 'b'").withColumn("ts", F.when(F.col("ts") != F.lit(datetime(2024, 1, 3)), F.col("ts")))
    assert rows_of(chunks.positions(df, replace(KEYED, chunk="1D"))) == rows_of(KEYED.positions(df))


def test_empty_series(rough):
    none = rough.where("false")
    assert rows_of(fills.process_missing(none, replace(KEYED, chunk="1D"), RULES)) == []


def test_one_long_series_takes_many_tasks(spark):
    df = spark.range(200_000).select(F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"), F.when(F.col("id") % 50_000 > 20_000, F.col("id").cast("double")).alias("v"))
    ax = Axis("ts", chunk="10D")
    cut, inner = chunks.split(df, ax)
    assert cut.groupBy("__chunk").count().agg(F.max("count"), F.count("*")).first()[0:2] == (14_400, 14)
    found = runs.runs_of(df, ax, is_missing("v")).orderBy("start_pos").collect()
    assert [(r.start_pos, r.length) for r in found] == [(i * 50_000, 20_001) for i in range(4)]
