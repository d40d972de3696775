"""Forecasting end to end on a synthetic solar station."""

import numpy as np
import pandas as pd
import pytest

from tidewatt.axis import Axis
from tidewatt.operators.splits import split_by_time
from tidewatt.plans.base import NotFittedError
from tidewatt.plans.forecaster import Forecaster, permutation_importance, shuffled_target_check
from tidewatt.plans.models import get_model, list_models

SPEC = {"name": "solar", "capacity": 50, "time": {"freq": "1h"}, "columns": {"POWER": {"role": "target"}, "INSOLATION": "feature", "T_AIR": "feature", "T_PANELS": {"available": "history"}, "DIRECTION": {"cyclic": 360}}}
AXIS = Axis("time")


@pytest.fixture(scope="module")
def solar(spark):
    rng = np.random.default_rng(4)
    t = pd.date_range("2021-03-01", periods=40 * 24, freq="h")
    sun = np.clip(np.sin(np.pi * (t.hour.to_numpy() - 6) / 12), 0, None)
    clouds = rng.uniform(0.5, 1, len(t))
    air = 8 + 10 * sun + rng.normal(0, 1, len(t))
    panels = air + 15 * sun * clouds
    power = 45 * sun * clouds * (1 - 0.004 * (panels - 25)) + abs(rng.normal(0, 0.05, len(t)))
    df = spark.createDataFrame(pd.DataFrame({"time": t, "POWER": power, "INSOLATION": 900 * sun * clouds, "T_AIR": air, "T_PANELS": panels, "DIRECTION": rng.uniform(0, 360, len(t))}))
    return split_by_time(df.withColumn("time", df.time.cast("timestamp_ntz")).cache(), AXIS, "5D", "5D")


def test_linear_recipe(spark, solar, tmp_path):
    f = Forecaster.from_recipe("linear", AXIS, spec=SPEC)
    with pytest.raises(NotFittedError):
        f.predict(solar.test)
    f.fit(solar.train, solar.val)
    scores = f.evaluate(solar.test)
    assert scores["r2"] > 0.9 and scores["nmae"] < 0.1
    assert f.info["history_only"] == ["T_PANELS"] and "DIRECTION_SIN" in f.feature_names and "HOUR_COS" in f.feature_names
    assert f.feature_importance()[0][1] >= f.feature_importance()[-1][1]
    f.save(str(tmp_path / "f"), spark)
    again = Forecaster.load(str(tmp_path / "f"), spark)
    assert again.evaluate(solar.test)["r2"] == pytest.approx(scores["r2"], abs=1e-9)


def test_recursive_first_step_is_one_step(solar):
    f = Forecaster("linear", AXIS, spec=SPEC, lags={"POWER": [1, 24]}, cyclic={"hour": 24}).fit(solar.train)
    history = solar.train.unionByName(solar.val)
    short = solar.test.orderBy("time").limit(3)
    one, rec = (r.orderBy("time").toPandas().prediction for r in (f.predict(short, history), f.predict_recursive(short, history)))
    assert one[0] == pytest.approx(rec[0]) and rec.notna().all() and len(rec) == 3
    assert f.required_inputs[-1] == "POWER"
    with pytest.raises(ValueError):
        f.predict_recursive(short, None)


def test_shuffled_target(solar):
    f = Forecaster.from_recipe("linear", AXIS, spec=SPEC).fit(solar.train)
    found = shuffled_target_check(f, solar.train, solar.test)
    assert found["real"] > 0.9 and found["shuffled"] < 0.3
    ranked = permutation_importance(f, solar.test, columns=["INSOLATION", "DIRECTION"], n_repeats=2)
    assert ranked[0][0] == "INSOLATION" and ranked[0][1] > ranked[1][1]


@pytest.mark.parametrize(("recipe", "params"), [("xgboost", {"n_estimators": 15}), ("random_forest", {"n_estimators": 10}), ("lstm", {"n_estimators": 6})])
def test_other_recipes(solar, recipe, params):
    f = Forecaster.from_recipe(recipe, AXIS, spec=SPEC, model_params=params).fit(solar.train, solar.val)
    got = f.predict(solar.test, solar.val)
    assert got.count() == solar.test.count() and got.where("prediction IS NOT NULL").count() == solar.test.count()
    assert f.evaluate(solar.test, solar.val)["r2"] > 0.7
    if recipe == "xgboost":
        assert 1 <= f.model.best_step <= 15 and len(f.model.history["val"]) == 15


def test_gaussian_process_intervals(solar):
    f = Forecaster.from_recipe("svgp", AXIS, spec=SPEC, model_params={"n_inducing": 80}).fit(solar.train)
    got = f.predict_interval(solar.test, k=2.0).toPandas()
    assert (got.lower <= got.prediction).all() and (got.prediction <= got.upper).all() and got["std"].gt(0).all()
    assert f.evaluate(solar.test)["r2"] > 0.6


def test_models_and_kinds(spark, solar):
    assert {"linear", "ridge", "random_forest", "xgboost", "knn", "svgp", "lstm"} <= set(list_models())
    with pytest.raises(KeyError):
        get_model("nothing")
    with pytest.raises(ValueError):
        Forecaster("linear", AXIS, lookback=3)
    f = Forecaster("knn", AXIS, spec=SPEC, feature_scaling="standard", model_params={"n_neighbors": 3}).fit(solar.train)
    assert f.evaluate(solar.test)["r2"] > 0.7
