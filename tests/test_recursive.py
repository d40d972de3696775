"""The recursive forecast of the whole test part against a plain loop, step by step."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from oracle import run_sql

from tidewatt import queries
from tidewatt.axis import Axis
from tidewatt.operators.splits import split_by_time
from tidewatt.plans.forecaster import Forecaster

SF = "/root/testdata/sf0.001"
HOUR = dt.timedelta(hours=1)


def looped(values, cut, w, b):
    """Forecasts after the cut from the values up to it, each feeding back."""
    known, out = {t: v for t, v in values.items() if t <= cut}, {}
    for t in sorted(t for t in values if t > cut):
        if all(known.get(t - k * HOUR) is not None for k in (1, 24)):
            out[t] = w[0] * known[t - HOUR] + w[1] * known[t - 24 * HOUR] + b
        else:
            out[t] = None
        known[t] = out[t]
    return out


def test_whole_query(spark):
    base = run_sql("WITH " + queries.BASE["hourly"] + " SELECT s, ts, n FROM hourly", SF)
    series = {s: dict(zip((t.to_pydatetime() for t in g.ts), g.n, strict=True)) for s, g in base.groupby("s")}
    cut = base.ts.max().to_pydatetime() - dt.timedelta(days=5)
    rows = [(1.0, v[t - HOUR], v[t - 24 * HOUR], v[t]) for v in series.values() for t in v if t <= cut and t - 24 * HOUR in v and t - HOUR in v]
    a = np.array(rows)
    b, *w = np.linalg.lstsq(a[:, :3], a[:, 3], rcond=None)[0]
    want = {(s, t): p for s, v in series.items() for t, p in looped(v, cut, w, b).items()}
    got = {(r.s, r.ts): r.prediction for r in queries.QUERIES["forecast_recursive_whole"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({t for _, t in got}) == 120
    assert all(p is not None for p in got.values())
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_loop_equals_written_steps(spark, monkeypatch):
    r = np.random.default_rng(1)
    t = pd.date_range("2024-01-01", periods=80, freq="h")
    df = pd.concat([pd.DataFrame({"s": s, "ts": t, "v": np.sin(np.arange(80) / 4) + r.normal(0, 0.1, 80), "x": r.normal(size=80)}) for s in ("a", "b")])
    df.loc[(df.s == "b") & (df.ts == t[76]), "x"] = np.nan  # one step of b has no forecast, and so none that need it
    df = spark.createDataFrame(df)
    split = split_by_time(df.withColumn("ts", df.ts.cast("timestamp_ntz")), Axis("ts", ("s",)), "5h")
    f = Forecaster("linear", Axis("ts", ("s",)), target="v", features=["x"], lags={"v": [1, 3], "x": [1]}, cyclic={"hour": 24}, freq="1h").fit(split.train)
    fast = f.predict_recursive(split.test, split.train).orderBy("s", "ts").toPandas()
    monkeypatch.delattr(type(f.model), "scorer")
    slow = f.predict_recursive(split.test, split.train).orderBy("s", "ts").toPandas()
    assert len(fast) == len(slow) == 10 and fast.prediction.isna().any()
    assert fast.prediction.to_numpy() == pytest.approx(slow.prediction.to_numpy(), nan_ok=True)
