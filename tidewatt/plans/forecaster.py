"""Forecasting: features, scaling, target transform and a model, as one plan."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..axis import Axis, micros
from ..functions.calendar import CALENDAR
from ..functions.missing import number, numeric_columns
from ..operators import features, metrics
from ..operators.scaling import Scaler, TargetTransform
from ..operators.time_axis import frequency
from ..spec import StationSpec
from .base import NotFittedError
from .models import Model, assembled, get_model

DAY_AND_YEAR = {"hour": 24, "day_of_year": 365.25}


@dataclass(frozen=True)
class Recipe:
    name: str
    model: str
    model_params: dict = field(default_factory=dict)
    forecaster: dict = field(default_factory=dict)
    description: str = ""


RECIPES: dict[str, Recipe] = {}


def register_recipe(recipe: Recipe, overwrite: bool = False) -> None:
    if recipe.name in RECIPES and not overwrite:
        raise KeyError(f"recipe {recipe.name!r} is there already")
    RECIPES[recipe.name] = recipe


for _r in (
    Recipe("xgboost", "xgboost", {}, {"calendar": ["year"], "cyclic": DAY_AND_YEAR}, "boosted trees on the features of the same time"),
    Recipe("lstm", "lstm", {}, {"cyclic": DAY_AND_YEAR, "feature_scaling": "minmax", "target_transform": "minmax", "lookback": 24}, "windows of a day"),
    Recipe("svgp", "svgp", {}, {"calendar": ["year"], "cyclic": DAY_AND_YEAR, "feature_scaling": {"method": "maxabs", "exclude_calendar_cyclic": True}, "target_transform": "minmax_logit"}, "sparse Gaussian process with intervals"),
    Recipe("linear", "linear", {}, {"cyclic": DAY_AND_YEAR, "feature_scaling": "standard"}, "linear baseline"),
    Recipe("random_forest", "random_forest", {}, {"calendar": ["year"], "cyclic": DAY_AND_YEAR}, "forest baseline"),
):
    register_recipe(_r)


def list_recipes() -> list[tuple[str, str, str]]:
    return [(r.name, r.model, r.description) for r in RECIPES.values()]


class Forecaster:
    """Rows are scored where all inputs are there, else the forecast is null. ``history`` gives earlier rows for lags,
    rolling statistics and windows; only as much of it is read as these need."""

    def __init__(self, model: str | Model, axis: Axis, *, target=None, features=None, calendar=None, cyclic=None, lags=None, rolling=None, drop=None, feature_scaling=None, target_transform=None, lookback=None, freq=None, check_gaps=True, use_spec_cyclic=True, interval_k=1.0, spec=None, model_params=None):
        self.options = {k: v for k, v in locals().items() if k != "self"}
        self.model: Model = get_model(model, **(model_params or {})) if isinstance(model, str) else model.clone()
        self.axis, self.spec = axis, StationSpec.load(spec) if spec is not None else None
        if (self.model.kind == "sequence") != bool(lookback):
            raise ValueError(f"a {self.model.kind} model {'needs' if self.model.kind == 'sequence' else 'takes no'} lookback")
        self.target_: str | None = None
        self.info: dict = {}

    @classmethod
    def from_recipe(cls, name: str, axis: Axis, *, model_params=None, spec=None, **overrides) -> "Forecaster":
        if name not in RECIPES:
            raise KeyError(f"unknown recipe {name!r}; known: {sorted(RECIPES)}")
        r = RECIPES[name]
        return cls(r.model, axis, spec=spec, model_params=r.model_params | (model_params or {}), **(copy.deepcopy(r.forecaster) | overrides))

    def clone(self) -> "Forecaster":
        return Forecaster(**self.options)

    @property
    def is_fitted(self) -> bool:
        return self.target_ is not None

    # ---- features
    def _bind(self, df: DataFrame) -> None:
        o = self.options
        target = o["target"] or (self.spec and self.spec.target)
        if not target:
            raise ValueError("no target is named")
        chosen = o["features"] if o["features"] is not None else (self.spec.features if self.spec else numeric_columns(df, (*self.axis.keys, self.axis.ts, self.axis.order)))
        self.inputs = [c for c in chosen if c in df.columns and c != target]
        self.step = micros(o["freq"]) if o["freq"] else micros(self.spec.time.freq) if self.spec and self.spec.time.freq else frequency(df, self.axis)
        self.periods = dict(o["cyclic"] or {}) | ({c: p for c, p in self.spec.cyclic_columns.items() if c in self.inputs} if self.spec and o["use_spec_cyclic"] else {})
        self.target_ = target

    @property
    def required_inputs(self) -> list[str]:
        return [*self.inputs, *([self.target_] if self._feeds_back else [])]

    @property
    def _feeds_back(self) -> bool:
        return self.target_ in (self.options["lags"] or {}) or self.target_ in (self.options["rolling"] or {})

    @property
    def _context(self) -> int:
        o = self.options
        steps = [k for ks in (o["lags"] or {}).values() for k in ks] + [w for r in (o["rolling"] or {}).values() for w in r["windows"]]
        return max(steps, default=0) + (o["lookback"] - 1 if o["lookback"] else 0)

    def _engineered(self, df: DataFrame, history: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """Rows with all features, ``__own`` where they are of ``df``, and the features' names."""
        o, ax = self.options, self.axis
        needed = list(dict.fromkeys([*self.inputs, self.target_, *(o["lags"] or {}), *(o["rolling"] or {})]))
        pick = lambda d: d.select(*ax.keys, ax.ts, *(number(c).alias(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in needed))
        rows = pick(df).withColumn("__own", F.lit(True))
        if history is not None and self._context:
            first = df.groupBy(*ax.keys).agg(F.min(ax.micros()).alias("__first"))
            past = pick(history)
            past = past.join(first, list(ax.keys)) if ax.keys else past.crossJoin(F.broadcast(first))  # one row
            reach = (self._context + 1) * self.step
            past = past.where((ax.micros() < F.col("__first")) & (ax.micros() >= F.col("__first") - reach)).drop("__first")
            rows = rows.unionByName(past.withColumn("__own", F.lit(False)))
        plain = rows.columns
        if o["calendar"]:
            rows = features.calendar_features(rows, ax.ts, o["calendar"])
        if self.periods:
            rows = features.cyclic_features(rows, ax.ts, self.periods)
        for c, lags in (o["lags"] or {}).items():
            rows = features.lag_features(rows, ax, [c], lags, self.step, check=False)
        for c, r in (o["rolling"] or {}).items():
            rows = features.rolling_features(rows, ax, [c], freq=self.step, **r)
        made = [c for c in rows.columns if c not in plain]
        names = [c for c in [*(i for i in self.inputs if i not in self.periods), *made] if c not in (o["drop"] or ())]
        return rows, names

    def _scaler(self, names: list[str]) -> Scaler | None:
        config = self.options["feature_scaling"]
        if config is None:
            return None
        config = {"method": config} if isinstance(config, str) else dict(config)
        skip = list(config.pop("exclude", ()))
        if config.pop("exclude_calendar_cyclic", False):
            skip += [n.upper() + s for n in self.periods if n in CALENDAR for s in ("_SIN", "_COS")]
        return Scaler(columns=names, exclude=tuple(skip), **config)

    def _design(self, df: DataFrame, history: DataFrame | None, need_target: bool) -> DataFrame:
        """Keys, timestamp, ``label`` and ``features`` of the rows of ``df`` whose inputs are complete."""
        rows, names = self._engineered(df, history)
        if self.scaler:
            rows = self.scaler.transform(rows)
        rows = rows.withColumn("label", self.transform.transform(number(self.target_)).cast("double"))
        ok = F.col("__own") & (F.col("label").isNotNull() if need_target else F.lit(True))
        if self.options["lookback"]:
            found = features.make_windows(rows, self.axis, names, self.options["lookback"], self.step, self.options["check_gaps"], ok)
            found = found.join(rows.where(ok).select(*self.axis.keys, self.axis.ts, "label"), [*self.axis.keys, self.axis.ts])
            return assembled(found, names, "window").drop("window", "position")
        for n in names:
            ok = ok & number(n).isNotNull()
        return assembled(rows.where(ok), names).select(*self.axis.keys, self.axis.ts, "label", "features")

    # ---- learning and forecasting
    def fit(self, data: DataFrame, validation: DataFrame | None = None, history: DataFrame | None = None) -> "Forecaster":
        self._bind(data)
        rows, names = self._engineered(data, history)
        own = rows.where("__own")
        self.feature_names = names
        self.scaler = self._scaler(names)
        if self.scaler:
            self.scaler.fit(own)
        self.transform = TargetTransform(self.options["target_transform"] or "identity").fit(data, self.target_)
        train = scratch.written(self._design(data, history, True), "train")
        before = data if history is None else history.unionByName(data, allowMissingColumns=True)
        val = None if validation is None else scratch.written(self._design(validation, before, True), "val")
        self.model.fit(train, val)
        self.info = {"rows": train.count(), "features": names, "validation_rows": val.count() if val is not None else 0}
        if self.spec:
            self.info["history_only"] = [c for c in self.inputs if self.spec.availability(c) == "history"]
        return self

    def _forecast(self, data: DataFrame, history, weights: str) -> DataFrame:
        if not self.is_fitted:
            raise NotFittedError("the forecaster is not fitted")
        out = self.model.transform(self._design(data, history, False), weights)
        extra = ["std"] if "std" in out.columns else []
        return out.select(*self.axis.keys, self.axis.ts, F.col("prediction").alias("__z"), *(F.col(e).alias("__s") for e in extra))

    def predict(self, data: DataFrame, history: DataFrame | None = None, weights: str = "best") -> DataFrame:
        """``data`` with ``prediction``, null where inputs are incomplete."""
        found = self._forecast(data, history, weights)
        joined = data.drop("prediction").join(found, [*self.axis.keys, self.axis.ts], "left")
        return joined.withColumn("prediction", self.transform.inverse_transform(F.col("__z"))).drop("__z", "__s")

    def predict_interval(self, data: DataFrame, history=None, k: float | None = None, weights: str = "best") -> DataFrame:
        """``prediction, lower, upper, std``: the inverse of mean and mean +- k deviations."""
        if not self.model.distribution:
            raise ValueError("the model gives no distribution")
        k = self.options["interval_k"] if k is None else k
        joined = data.join(self._forecast(data, history, weights), [*self.axis.keys, self.axis.ts], "left")
        back = self.transform.inverse_transform
        joined = joined.withColumns({"prediction": back(F.col("__z")), "lower": back(F.col("__z") - k * F.col("__s")), "upper": back(F.col("__z") + k * F.col("__s"))})
        return joined.withColumn("std", (F.col("upper") - F.col("lower")) / (2 * k)).drop("__z", "__s")

    def predict_recursive(self, data: DataFrame, history: DataFrame, weights: str = "best") -> DataFrame:
        """Forecast one time after another, feeding forecasts back as the target of later lags: parallel over series,
        sequential in time. Without features of the target it is ``predict``. A linear model whose only features of the
        target are lags, unscaled, walks through each series in one task; else each step is a small written table."""
        if history is None:
            raise ValueError("a recursive forecast needs history")
        if not self._feeds_back:
            return self.predict(data, history, weights)
        o = self.options
        if hasattr(self.model, "scorer") and self.target_ not in (o["rolling"] or {}) and o["feature_scaling"] is None and o["target_transform"] is None and not o["lookback"]:
            return self._walked(data, history)
        ax, blank = self.axis, data.withColumn(self.target_, F.lit(None).cast("double"))
        times = [r[0] for r in data.select(ax.ts).distinct().orderBy(ax.ts).collect()]  # the horizon, not the rows
        done = None
        for t in times:
            past = history
            if done is not None:  # with the other columns of the steps before, which may be lagged too
                past = history.unionByName(data.drop(self.target_, "prediction").join(done.withColumnRenamed("prediction", self.target_), [*ax.keys, ax.ts]), allowMissingColumns=True)
            one = self.predict(blank.where(F.col(ax.ts) == F.lit(t)), past, weights).select(*ax.keys, ax.ts, "prediction")
            done = scratch.written(one if done is None else done.unionByName(one), "recursive")
        return data.drop("prediction").join(done, [*ax.keys, ax.ts], "left")

    def _walked(self, data: DataFrame, history: DataFrame) -> DataFrame:
        """``predict_recursive`` by one loop over the times of each series. A series is the unit of a task."""
        ax, target, names, step, score = self.axis, self.target_, self.feature_names, self.step, self.model.scorer()
        lags = {f"{target}_lag_{k}": k for k in self.options["lags"][target]}
        rows, _ = self._engineered(data.withColumn(target, F.lit(None).cast("double")), history)
        rows = rows.select(*ax.keys, ax.ts, ax.micros().cast("long").alias("__t"), "__own", number(target).alias("__v"), *(number(n).cast("double").alias(f"__f{i}") for i, n in enumerate(names)))

        def walk(pdf):
            pdf = pdf.sort_values("__t", kind="stable")
            known: dict[int, float] = {}
            x = pdf[[f"__f{i}" for i in range(len(names))]].to_numpy(float)
            moved = [(i, lags[n] * step) for i, n in enumerate(names) if n in lags]
            out = np.full(len(pdf), np.nan)
            for r, (t, own, v) in enumerate(zip(pdf["__t"].tolist(), pdf["__own"].tolist(), pdf["__v"].tolist(), strict=True)):
                if own:
                    for i, back in moved:
                        x[r, i] = known.get(t - back, np.nan)
                    v = out[r] = score(x[r]) if not np.isnan(x[r]).any() else np.nan
                known.setdefault(t, v)
            found = pdf[[*ax.keys, ax.ts]].assign(prediction=out)[pdf["__own"].to_numpy()]
            return found.drop_duplicates([*ax.keys, ax.ts])

        schema = T.StructType([*(data.schema[c] for c in (*ax.keys, ax.ts)), T.StructField("prediction", T.DoubleType())])
        found = rows.withColumn("__all", F.lit(0)).groupBy(*(ax.keys or ("__all",))).applyInPandas(walk, schema)
        found = found.withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double")))
        return data.drop("prediction").join(found, [*ax.keys, ax.ts], "left")

    def evaluate(self, data: DataFrame, history=None, metrics_=("nmae", "nrmse", "r2"), norm: float | None = None, weights: str = "best", percent: bool = False) -> dict:
        """Metrics over all rows; errors are divided by ``norm``, the capacity, or the largest absolute target."""
        norm = norm or (self.spec and self.spec.capacity) or data.agg(F.max(F.abs(number(self.target_)))).first()[0]
        row = metrics.evaluate(self.predict(data, history, weights), self.target_, "prediction", metrics_, norm=float(norm), percent=percent).first()
        return row.asDict()

    def feature_importance(self) -> list[tuple[str, float]]:
        names, found = self.feature_names, self.model.importance()
        if self.options["lookback"]:
            found = [sum(found[i :: len(names)]) for i in range(len(names))]
        return sorted(zip(names, found, strict=True), key=lambda p: -p[1])

    # ---- keeping
    def save(self, path: str, spark) -> None:
        """The model in its own format, everything else as JSON beside it."""
        self.model.save(f"{path}/model")
        o = {k: v for k, v in self.options.items() if k not in ("axis", "spec", "model", "model_params")}
        state = {"options": o, "axis": vars(self.axis), "spec": self.spec.to_dict() if self.spec else None, "model": self.options["model"], "model_params": self.model.params, "target": self.target_, "inputs": self.inputs, "step": self.step, "periods": self.periods, "features": self.feature_names, "scaler": vars(self.scaler) if self.scaler else None, "transform": vars(self.transform)}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str, spark) -> "Forecaster":
        s = json.loads(spark.read.text(f"{path}/state").first().value)
        axis = Axis(s["axis"]["ts"], tuple(s["axis"]["keys"]), s["axis"]["order"], s["axis"].get("chunk"))
        out = cls(s["model"], axis, spec=s["spec"], model_params=s["model_params"], **s["options"])
        out.target_, out.inputs, out.step, out.periods, out.feature_names = s["target"], s["inputs"], s["step"], s["periods"], s["features"]
        out.scaler = None if s["scaler"] is None else Scaler(**(s["scaler"] | {"exclude": tuple(s["scaler"]["exclude"]), "feature_range": tuple(s["scaler"]["feature_range"])}))
        out.transform = TargetTransform(**s["transform"])
        out.model.load(f"{path}/model")
        return out


# ---- checks
def permuted(df: DataFrame, axis: Axis, columns: list[str], seed: int) -> DataFrame:
    """Values of columns moved to other rows of the same series, together."""
    from pyspark.sql import Window

    w = lambda order: F.row_number().over(Window.partitionBy(*axis.keys).orderBy(order, axis.ts))
    left = df.drop(*columns).withColumn("__k", w(F.xxhash64(axis.ts, F.lit(seed))))
    right = df.select(*axis.keys, axis.ts, *columns).withColumn("__k", w(F.xxhash64(axis.ts, F.lit(seed + 1)))).drop(axis.ts)
    return left.join(right, [*axis.keys, "__k"]).select(df.columns)


def shuffled_target_check(forecaster: Forecaster, train: DataFrame, test: DataFrame, val: DataFrame | None = None, history=None, seed: int = 42, metric: str = "r2") -> dict:
    """The score of the same forecaster refitted on a shuffled target: it should be poor."""
    target = forecaster.options["target"] or forecaster.spec.target
    shuffled = forecaster.clone().fit(permuted(train, forecaster.axis, [target], seed), None if val is None else permuted(val, forecaster.axis, [target], seed))
    return {"real": forecaster.evaluate(test, history, [metric])[metric], "shuffled": shuffled.evaluate(test, history, [metric])[metric]}


def permutation_importance(forecaster: Forecaster, data: DataFrame, history=None, columns=None, metric: str = "rmse", n_repeats: int = 5, seed: int = 0) -> list[tuple[str, float, float]]:
    """Column, mean and deviation (ddof 0) of how much worse the error gets when the column is shuffled."""
    sign = -1 if metric in ("r2", "coverage") else 1
    base = forecaster.evaluate(data, history, [metric])[metric]
    out = []
    for i, c in enumerate(columns or forecaster.inputs):
        worse = [sign * (forecaster.evaluate(permuted(data, forecaster.axis, [c], seed + 100 * i + 2 * r), history, [metric])[metric] - base) for r in range(n_repeats)]
        mean = sum(worse) / len(worse)
        out.append((c, mean, (sum((w - mean) ** 2 for w in worse) / len(worse)) ** 0.5))
    return sorted(out, key=lambda r: -r[1])
