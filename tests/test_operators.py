"""Operators on small frames with results worked out by hand."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatt.axis import Axis
from tidewatt.functions.missing import is_missing
from tidewatt.operators import features, fills, merge, metrics, outliers, quality, runs, scaling, splits, stats, time_axis
from tidewatt.operators.rules import ColumnRules, RunRule, build_rules, parse_runs
from tidewatt.plans.base import Function, NotFittedError, PerSeries, Pipeline
from tidewatt.plans.cleaner import Cleaner

AX = Axis("ts")
N = None


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    rows = [(datetime(2021, 1, 1) + timedelta(hours=i), *(float(c[i]) if c[i] is not None else None for c in cols.values())) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))


def values(df, c):
    return [None if r[0] is None else round(r[0], 6) for r in df.orderBy("ts").select(c).collect()]


def filled(spark, data, **rules):
    return values(fills.filled(frame(spark, A=data), AX, {"A": ColumnRules.of(rules)}), "A")


def test_run_positions(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    found = runs.runs_of(frame(spark, A=flags), AX, F.col("A") == 1).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.length) for r in found] == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]
    assert values(runs.run_lengths(frame(spark, A=flags), AX, F.col("A") == 1), "run_length") == [0, 2, 2, 0, 1, 0, 0, 3, 3, 3]


def test_actions_by_length(spark):
    data = [1, N, 3, 4, N, N, N, N, 9, 10, N, N, N, N, N, 16]
    got = filled(spark, data, runs={"keep": [1, 1], "interpolate": [2, 4], "set_nan": [5, None]})
    assert got == [1, N, 3, 4, 5, 6, 7, 8, 9, 10, N, N, N, N, N, 16]


def test_zeros_and_missing_merge(spark):
    assert filled(spark, [5, 0, 0, N, 0, 7], zeros=True, runs={"interpolate": [4, 4]}) == [5, 5.4, 5.8, 6.2, 6.6, 7]
    assert filled(spark, [5, 0, 0, N, 0, 7], zeros=True, merge=False, runs={"interpolate": [1, 1]}) == [5, 0, 0, 2.333333, 4.666667, 7]


def test_edges_stay_and_nan_to_zero(spark):
    assert filled(spark, [N, N, 1, N, 3, N], runs={"interpolate": [1, None]}) == [N, N, 1, 2, 3, N]
    assert filled(spark, [N, N, 1, N, 3, N], nan_to_zero=True) == [0, 0, 1, 0, 3, 0]
    assert filled(spark, [1, float("inf"), 3, float("nan"), 5], runs={"interpolate": [1, None]}) == [1, 2, 3, 4, 5]


def test_carrying(spark):
    assert filled(spark, [1, N, N, N, 5], runs={"ffill": [1, 3]}) == [1, 1, 1, 1, 5]
    assert filled(spark, [1, N, N, N, 5], runs={"bfill": [1, 3]}) == [1, 5, 5, 5, 5]
    assert values(fills.forward_fill(frame(spark, A=[1, N, N, N, 5]), AX, ["A"], 2), "A") == [1, N, N, N, 5]


def test_drop_scope(spark):
    df = frame(spark, A=[1] * 8, B=[1, N, N, N, N, N, 1, 1])
    rules = {c: ColumnRules.of({"runs": {"drop_rows": [5, None]}}) for c in "AB"}
    assert fills.dropped_runs(df, AX, rules).count() == 3 and fills.dropped_runs(df, AX, rules, ["A"]).count() == 8


def test_grouped_median(spark):
    data = [float(i % 24) for i in range(48)]
    data[30] = N
    df = frame(spark, A=data)
    assert values(fills.median_imputed(df, df, AX, ["A"], ["hour"]), "A")[30] == 6.0


def test_rules_are_checked():
    assert parse_runs({"keep": [[1, 2], [9, None]], "ffill": [3, 4]}) == (RunRule(1, 2, "keep"), RunRule(3, 4, "ffill"), RunRule(9, None, "keep"))
    assert parse_runs([{"length": [1, 3], "action": "set_nan"}]) == (RunRule(1, 3, "set_nan"),)
    for bad in ({"keep": [1, 3], "ffill": [3, 4]}, {"keep": [1, None], "ffill": [3, 4]}, {"explode": [1, 2]}, {"keep": [0, 2]}, {"keep": [3, 2]}):
        with pytest.raises(ValueError):
            parse_runs(bad)
    with pytest.raises(ValueError):
        build_rules({"columns": {"A": {"runes": {}}}}, ["A"])
    with pytest.raises(ValueError):
        build_rules({"cols": {}}, ["A"])


def test_profiles(spark):
    df = frame(spark, A=[1, N, N, 0, 5, 0, 0, 0, 7, N, 2, 3], B=list(range(1, 13)))
    table = quality.run_length_table(df, AX, ["A", "B"]).collect()
    assert sorted((r.column, r.length, r.runs, r.points) for r in table) == [("A", 1, 1, 1), ("A", 3, 2, 6)]
    kinds = [(r.kind, r.length, r.n_nan, r.n_zeros) for r in quality.blocks(df, AX, ["A"], 2).orderBy("start").collect()]
    assert kinds == [("nan+zero", 3, 2, 1), ("zero", 3, 0, 3)]
    stats_ = quality.describe_columns(df, ["A"]).first()
    assert (stats_.n, stats_.nan, stats_.zeros, stats_.nan_pct) == (12, 3, 4, 25.0)
    assert [round(r.A, 4) for r in quality.missing_map(df, AX, ["A"], 3).orderBy("ts").collect()] == [0.5, 0.0, 0.25]


def test_duplicates_and_grid(spark):
    t = datetime(2021, 1, 1)
    df = spark.createDataFrame([(t, 1.0), (t + timedelta(hours=1), 2.0), (t + timedelta(hours=1), 4.0), (t + timedelta(hours=3), 5.0)], "ts timestamp_ntz, A double")
    assert values(time_axis.prepared(df, AX, fill_missing_timestamps=True), "A") == [1, 3, N, 5]
    assert values(time_axis.deduplicated(df, AX, "drop"), "A") == [1, 5]
    with pytest.raises(ValueError):
        time_axis.deduplicated(df, AX, "error")
    with pytest.raises(ValueError):
        features.lag_features(df, AX, ["A"], [1], "1h")


def test_outliers(spark):
    data = list(np.random.default_rng(0).normal(10, 1, 200))
    data[50], data[60], data[70] = 100.0, 0.0, -80.0
    df = frame(spark, P=data)
    flagged = outliers.OutlierProcessor(AX, {"zscore": {"threshold": 5}}, limits={"P": (-50, None)}, action="flag").fit(df).transform(df)
    hit = [i for i, v in enumerate(values(flagged, "P_outlier")) if v]
    assert 50 in hit and 70 in hit and 60 not in hit
    clipped = values(outliers.OutlierProcessor(AX, {}, limits={"P": (-50, 40)}, action="clip").fit(df).transform(df), "P")
    assert clipped[50] == 40 and clipped[70] == -50
    assert outliers.OutlierProcessor(AX, {}, limits={"P": (-50, 40)}, action="drop_rows").fit(df).transform(df).count() == 198
    with pytest.raises(ValueError):
        outliers.OutlierProcessor(AX, {"iqr": {}}, apply=["zscore"])
    with pytest.raises(KeyError):
        outliers.make_detector("nose")


def test_statistics_come_from_training(spark):
    train, test = frame(spark, P=[10, 12] * 50), frame(spark, P=[11, 30])
    done = outliers.OutlierProcessor(AX, {"zscore": {}}, action="set_nan").fit(train).transform(test)
    assert values(done, "P") == [11, N]


HOURS = 900


def dirty(spark):
    """Two slow waves and a turning direction, with runs of every kind cut into them."""
    i = np.arange(HOURS)
    cols = {"LOAD": list(20 + 8 * np.sin(i / 17) + (i * 7 % 11) / 5), "TEMP": list(6 + 3 * np.cos(i / 23) + (i * 5 % 13) / 9), "DIR": list(1.0 + i * 37 % 357)}
    for name, value, first, last in (
        ("LOAD", 0.0, 60, 62), ("LOAD", N, 140, 151), ("TEMP", 0.0, 146, 149), ("TEMP", N, 300, 335), ("DIR", N, 520, 522), ("DIR", 0.0, 523, 525),
        ("LOAD", 0.0, 700, 727), ("TEMP", N, 0, 6), ("LOAD", 900.0, 610, 610), ("TEMP", 88.0, 640, 640),
    ):
        cols[name][first : last + 1] = [value] * (last + 1 - first)
    return frame(spark, **cols)


CONFIG = {
    "time": {"duplicates": "keep"},
    "missing": {"defaults": {"zeros": True, "runs": {"keep": [1, 3], "interpolate": [4, 20], "drop_rows": [21, None]}}},
    "outliers": {"detectors": {"zscore": {"threshold": 6}, "iqr": {"factor": 5}, "hampel": {"window": 48, "n_sigmas": 15}}, "apply": ["zscore"], "action": "interpolate"},
}
LIMITS = {"LOAD": (-20, None), "TEMP": (-40, 50)}


def test_cleaner(spark):
    df = dirty(spark).cache()
    cleaner = Cleaner(AX, CONFIG, LIMITS)
    with pytest.raises(NotFittedError):
        cleaner.transform(df)
    out = cleaner.fit(df).transform(df).toPandas().sort_values("ts").set_index("ts")
    at = lambda i: datetime(2021, 1, 1) + timedelta(hours=i)
    assert len(out) == HOURS - 36 - 28 and at(310) not in out.index and at(715) not in out.index
    assert (out.LOAD[at(60) : at(62)] == 0).all() and out.LOAD[at(140) : at(151)].between(10, 32).all()
    assert out.LOAD[at(610)] < 32 and out.TEMP[at(640)] < 12 and (out.DIR[at(520) : at(525)] > 0).all()
    assert out.TEMP[at(0) : at(6)].isna().all() and (out.TEMP[at(146) : at(149)] != 0).all()
    report = cleaner.get_report(df)
    counts = report["counts"].first()
    assert (counts.rows_before, counts.rows_dropped, counts.rows_after, counts.excluded_values) == (HOURS, 64, HOURS - 64, 0)
    assert sorted((r.rows, r.reason) for r in report["removed_periods"].collect()) == [(28, "LOAD"), (36, "TEMP")]
    fills_ = {r.column: r for r in report["fills"].collect()}
    assert fills_["LOAD"].outliers_interpolated == 1 and fills_["TEMP"].interpolation_failed == 7
    scoped = Cleaner(AX, CONFIG, LIMITS, drop_scope=["LOAD", "DIR"]).fit(df)
    assert scoped.transform(df).count() == HOURS - 28
    excluded = Cleaner(AX, CONFIG | {"exclude": [{"start": "2021-01-12 00:00", "end": "2021-01-12 08:00", "columns": ["LOAD"]}]}, LIMITS).fit(df)
    assert excluded.get_report(df)["counts"].first().excluded_values == 9
    with pytest.raises(ValueError):
        Cleaner(AX, {"cleen": {}})


def test_time_aware_lags_and_rolling(spark):
    df = frame(spark, P=[0, 1, 2, 3, 4, 5]).where("P <> 3")
    assert values(features.lag_features(df, AX, ["P"], [1], "1h"), "P_lag_1") == [N, 0, 1, N, 4]
    rolled = features.rolling_features(frame(spark, P=[1, 2, 3, 4, 100]), AX, ["P"], [2], ["mean"], "1h")
    assert values(rolled, "P_roll_mean_2") == [N, N, 1.5, 2.5, 3.5]


def test_windows_skip_gaps(spark):
    df = frame(spark, A=list(range(50)), B=[N if i == 30 else float(i) for i in range(50)]).where("A <> 20")
    got = [r.position for r in features.make_windows(df, AX, ["A", "B"], 6, "1h").orderBy("position").collect()]
    rows = [i for i in range(50) if i != 20]
    want = [k for k in range(5, 49) if all(rows[k - j] == rows[k] - j and rows[k - j] != 30 for j in range(6))]
    assert got == want


def test_metrics_by_hand(spark):
    df = frame(spark, y=[0, 10, 20], p=[1, 9, 23])
    row = metrics.evaluate(df, "y", "p", ["mae", "rmse", "bias", "nmae", "mape", "r2"], norm=50.0, percent=True).first()
    assert row.mae == pytest.approx(5 / 3) and row.rmse == pytest.approx(math.sqrt(11 / 3)) and row.bias == pytest.approx(1)
    assert row.nmae == pytest.approx(10 / 3) and row.mape == pytest.approx(12.5) and row.r2 == pytest.approx(1 - 11 / 200)
    with pytest.raises(ValueError):
        metrics.evaluate(df, "y", "p", ["nmae"])
    flat = metrics.evaluate(frame(spark, y=[5, 5], p=[5, 5]), "y", "p", ["r2"]).first()
    assert flat.r2 == 1.0


def test_window_counts(spark):
    df = frame(spark, y=[float(i % 50) for i in range(720)], p=[0.0] * 720)
    assert metrics.evaluate_by_window(df, AX, "y", "p", 120, 24, ["mae"]).count() == 26
    assert metrics.evaluate_by_window(df, AX, "y", "p", "5D", "1D", ["mae"]).count() == 26


def test_scaling(spark):
    df = frame(spark, P=[0, 25, 40])
    assert values(scaling.Scaler("maxabs", ["P"], scale=50).fit(df).transform(df), "P") == [0, 0.5, 0.8]
    t = scaling.TargetTransform("minmax_logit").fit(df, "P")
    back = values(df.withColumn("P", t.inverse_transform(t.transform(F.col("P")))), "P")
    assert back == pytest.approx([0, 25, 40], abs=0.01)


def test_statistics(spark):
    df = frame(spark, a=[1, 2, 3, 4, N], b=[2, 4, 6, 9, 1], c=[4, 3, 2, 1, 0])
    r = {(x.a, x.b): x.r for x in stats.correlation(df, ["a", "b", "c"], "spearman").collect()}
    assert r[("a", "b")] == pytest.approx(1) and r[("a", "c")] == pytest.approx(-1)
    assert stats.kendall(np.array([1, 2, 3, 4]), np.array([1, 3, 2, 4])) == pytest.approx(2 / 3)
    wave = frame(spark, v=[math.sin(2 * math.pi * i / 12) for i in range(240)])
    top = stats.spectrum(wave, AX, "v").orderBy(F.desc("power")).first()
    assert top.period_steps == pytest.approx(12) and top.period_hours == pytest.approx(12)
    lags = {r.lag: r.acf for r in stats.acf(wave, AX, "v", 12).collect()}
    assert lags[0] == pytest.approx(1) and lags[12] > 0.9 and lags[6] < -0.9


def test_merge_rules(spark):
    a, b = frame(spark, P=[1, 2], T=[5, 6]), frame(spark, T=[7, N], X=[N, N])
    merged = merge.merge_by_time({"a": a, "b": b}, AX)
    assert merged.columns == ["ts", "P", "a_T", "b_T"]
    with pytest.raises(ValueError):
        merge.merge_by_time({"a": a, "b": b}, AX, prefix=False)


def test_splits(spark):
    df = frame(spark, P=list(range(100)))
    s = splits.split_by_time(df, AX, 24, 12)
    assert [p.count() for p in s.parts().values()] == [64, 12, 24]
    s = splits.split_by_time(df, AX, "1D", "12h")
    assert [p.count() for p in s.parts().values()] == [64, 12, 24]
    for bad in ("720", 200):
        with pytest.raises(ValueError):
            splits.split_by_time(df, AX, bad)
    folds = splits.expanding_window_splits(df, AX, 3, 10)
    assert [f.train.count() for f in folds] == [70, 80, 90]


def test_splits_by_rows_of_many_series(spark):
    df = frame(spark, P=list(range(50))).crossJoin(spark.range(4).withColumnRenamed("id", "s"))
    s = splits.split_by_time(df, Axis("ts", ("s",)), 10, 5)
    assert [p.count() for p in s.parts().values()] == [35 * 4, 5 * 4, 10 * 4]
    assert [(r.part, r.rows) for r in s.boundaries(AX).orderBy("start").collect()] == [("train", 140), ("val", 20), ("test", 40)]


def test_per_series(spark):
    df = frame(spark, P=[1, 2, 3]).crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "s string"))
    times = lambda k: Function(lambda x: x.withColumn("P", F.col("P") * k))
    step = PerSeries("s", {"a": times(10), "b": times(100)})
    got = sorted((r.s, r.P) for r in step.fit(df).transform(df).collect())
    assert got == [(s, p * k) for s, k in (("a", 10), ("b", 100), ("c", 1)) for p in (1, 2, 3)]
    with pytest.raises(KeyError):
        PerSeries("s", {"a": times(10), "x": times(2)}, strict=True).fit(df)
    with pytest.raises(ValueError):
        PerSeries("nowhere", {"a": times(10)}).fit(df)


def test_seed():
    from tidewatt.functions import seed

    seed.set_seed(7)
    first = np.random.rand(3).tolist()
    assert seed.current() == 7 and seed.set_seed(7) == 7 and np.random.rand(3).tolist() == first
    seed.set_seed(42)


def test_pipeline(spark):
    df = frame(spark, P=[1, N, 3])
    pipe = Pipeline([Function(lambda d: fills.linear_interpolation(d, AX, ["P"])), Function(lambda d: d.withColumn("P", F.col("P") * 2))])
    assert pipe.stateless and list(pipe.named_steps) == ["Function", "Function_2"]
    assert values(pipe.fit(df).transform(df), "P") == [2, 4, 6] and values(pipe.clone().transform(df), "P") == [2, 4, 6]
    assert is_missing("P") is not None
