"""Regression models on vectors of features: a thin layer over Spark ML, and a sparse Gaussian process."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seed
from ..scratch import written

MODELS: dict[str, type] = {}


def register(*names: str):
    def put(cls):
        for n in names:
            if n in MODELS:
                raise KeyError(f"model {n!r} is there already")
            MODELS[n] = cls
        return cls

    return put


def get_model(name: str, **params) -> "Model":
    if name.lower() not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {list_models()}")
    return MODELS[name.lower()](**params)


def list_models() -> list[str]:
    return sorted(MODELS)


class Model:
    """``fit`` takes frames with ``features`` (vector) and ``label``; ``transform`` adds ``prediction``, and ``std``
    where the model knows its uncertainty. ``history`` has the loss of each step, where there are steps."""

    kind = "table"
    distribution = False
    reader: type | None = None

    def __init__(self, **params):
        self.params, self.fitted, self.history, self.best_step = params, None, {}, None

    def clone(self) -> "Model":
        return type(self)(**self.params)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> "Model":
        self.fitted = self._estimator(train).fit(train)
        return self

    def _estimator(self, train: DataFrame):
        raise NotImplementedError

    def transform(self, df: DataFrame, weights: str = "best") -> DataFrame:
        return self.fitted.transform(df)

    def importance(self) -> list[float]:
        return [float(x) for x in self.fitted.featureImportances.toArray()]

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)

    def load(self, path: str) -> "Model":
        self.fitted = self.reader.load(path)
        return self


@register("linear", "ridge")
class Linear(Model):
    """Least squares by the normal equations; ``alpha`` adds the ridge penalty alpha * |w|^2."""

    reader = LinearRegressionModel

    def _estimator(self, train):
        alpha, reg = self.params.get("alpha", 0.0), 0.0
        if alpha:
            n, spread = train.agg(F.count("*"), F.stddev_pop("label")).first()
            reg = alpha * spread / n  # Spark divides the label by its deviation
        return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")

    def scorer(self):
        """Predictions of rows of features in numpy."""
        w, b = self.fitted.coefficients.toArray(), self.fitted.intercept
        return lambda x: x @ w + b

    def importance(self):
        return [abs(float(x)) for x in self.fitted.coefficients]


@register("random_forest")
class Forest(Model):
    reader = RandomForestRegressionModel

    def _estimator(self, train):
        return RandomForestRegressor(numTrees=self.params.get("n_estimators", 100), maxDepth=self.params.get("max_depth", 8), seed=self.params.get("seed", seed.current()))


@register("gradient_boosting", "xgboost")
class Boosting(Model):
    """Boosted trees. With validation rows the best number of trees is the one of smallest error there, told by one
    evaluation of each prefix; ``weights="last"`` uses all trees. Spark has no L2 term on leaves."""

    reader = GBTRegressionModel

    def _estimator(self, train, n: int | None = None):
        p = {"n_estimators": 60, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8, "colsample": 0.8, "seed": seed.current()} | self.params
        return GBTRegressor(maxIter=n or p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]), seed=p["seed"])

    def fit(self, train, val=None):
        self.last = self.fitted = self._estimator(train).fit(train)
        if val is not None and not val.isEmpty():
            errors = self.last.evaluateEachIteration(val.select("features", "label"), "squared")
            self.history, self.best_step = {"val": [float(np.sqrt(e)) for e in errors]}, int(np.argmin(errors)) + 1
            if self.best_step < len(errors):  # boosting is sequential: the same seed gives the same first trees
                self.fitted = self._estimator(train, self.best_step).fit(train)
        return self

    def transform(self, df, weights="best"):
        return (self.fitted if weights == "best" else self.last).transform(df)

    def save(self, path):
        """Both the best and the last trees, and the history."""
        from pyspark.sql import SparkSession

        for name, trees in (("best", self.fitted), ("last", self.last)):
            trees.write().overwrite().save(f"{path}/{name}")
        text = json.dumps({"history": self.history, "best_step": self.best_step})
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    def load(self, path):
        from pyspark.sql import SparkSession

        self.fitted, self.last = self.reader.load(f"{path}/best"), self.reader.load(f"{path}/last")
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first().value)
        self.history, self.best_step = about["history"], about["best_step"]
        return self


@register("knn")
class Nearest(Model):
    """Mean label of the k nearest training rows. The training rows are kept in blocks on the executors and each
    query meets one block at a time, so no pair of rows is ever materialised; the k best of each block are merged."""

    BLOCK = 20_000

    def fit(self, train, val=None):
        rows = train.select(vector_to_array("features").alias("x"), "label")
        n = rows.count()
        block = F.pmod(F.xxhash64("x", "label"), F.lit(max(1, -(-n // self.BLOCK))))
        self.fitted = written(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("x", "label")).alias("rows")), "knn")
        return self

    def transform(self, df, weights="best"):
        k, spark = self.params.get("n_neighbors", 5), df.sparkSession
        best = None
        rows = df.withColumn("__id", F.xxhash64("features"))
        for (b,) in self.fitted.select("block").collect():
            held = spark.sparkContext.broadcast([(np.array([r.x for r in g.rows]), np.array([r.label for r in g.rows])) for g in self.fitted.where(F.col("block") == b).collect()][0])

            def near(batches, held=held):
                import pandas as pd

                x, y = held.value
                for pdf in batches:
                    q = np.array(pdf.x.tolist()).reshape(len(pdf), -1)
                    d = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
                    at = np.argsort(d, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"__id": pdf["__id"], "near": [[{"d": float(d[i, j]), "y": float(y[j])} for j in row] for i, row in enumerate(at)]})

            one = rows.select("__id", vector_to_array("features").alias("x")).distinct().mapInPandas(near, "__id long, near array<struct<d:double,y:double>>")
            best = one if best is None else best.unionByName(one)
        merged = best.groupBy("__id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        mean = F.aggregate("near", F.lit(0.0), lambda a, s: a + s["y"]) / F.size("near")
        return rows.join(merged.select("__id", mean.alias("prediction")), "__id").drop("__id")

    def importance(self):
        raise ValueError("nearest neighbours have no importances")


@register("svgp")
class SparseGP(Model):
    """Gaussian process with inducing points and the collapsed bound (Titsias 2009). Only the sums K_uf K_fu and
    K_uf y over all rows are needed, which are added up on the executors; the m x m system is solved on the driver.
    Inducing points are rows chosen by hash: ``n_inducing`` of them, or ``inducing_fraction`` of the rows but at most
    ``MOST``, for the driver solves a system of their number; length scales are the features' deviations times the root of their
    number, and the noise is re-estimated from the residuals."""

    distribution = True
    MOST = 300

    def fit(self, train, val=None):
        rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        n, mean, var = rows.agg(F.count("*"), F.avg("y"), F.var_pop("y")).first()
        d = len(rows.first().x)
        spread = rows.agg(*(F.stddev_pop(F.col("x")[i]) for i in range(d))).first()
        scale = np.array([s or 1.0 for s in spread]) * np.sqrt(d) * self.params.get("lengthscale", 1.0)
        m = self.params.get("n_inducing") or min(max(10, int(n * self.params.get("inducing_fraction", 0.05))), self.MOST)
        z = np.array([r.x for r in rows.select("x").distinct().orderBy(F.xxhash64("x")).limit(m).collect()]) / scale
        held = train.sparkSession.sparkContext.broadcast((z, scale))

        def sums(batches):
            import pandas as pd

            z, scale = held.value
            g, b = np.zeros((len(z), len(z))), np.zeros(len(z))
            for pdf in batches:
                k = rbf(np.array(pdf.x.tolist()).reshape(len(pdf), -1) / scale, z)
                g += k.T @ k
                b += k.T @ (pdf.y.to_numpy() - mean)
            yield pd.DataFrame({"i": np.arange(len(z)), "row": [np.append(r, v) for r, v in zip(g, b, strict=True)]})

        parts = rows.mapInPandas(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        full = np.zeros((len(z), len(z) + 1))
        full[parts.i, parts.j] = parts.v
        g, b, signal, noise = full[:, :-1], full[:, -1], max(var, 1e-12), 0.1 * max(var, 1e-12)
        kuu = signal * rbf(z, z) + 1e-6 * signal * np.eye(len(z))
        for _ in range(10):
            inner = kuu + signal**2 * g / noise
            alpha = np.linalg.solve(inner, signal * b / noise)
            noise = max((n * var - 2 * signal * b @ alpha + signal**2 * alpha @ g @ alpha) / n, 1e-6 * signal)
        inner = kuu + signal**2 * g / noise
        self.fitted = {"z": z, "scale": scale, "mean": mean, "signal": signal, "noise": noise, "alpha": np.linalg.solve(inner, signal * b / noise), "shrink": np.linalg.inv(kuu) - np.linalg.inv(inner)}
        return self

    def transform(self, df, weights="best"):
        held = df.sparkSession.sparkContext.broadcast(self.fitted)

        @F.pandas_udf("struct<prediction:double,std:double>")
        def predict(x):
            import pandas as pd

            f = held.value
            k = f["signal"] * rbf(np.array(x.tolist()).reshape(len(x), -1) / f["scale"], f["z"])
            var = f["signal"] + f["noise"] - np.einsum("ij,jk,ik->i", k, f["shrink"], k)
            return pd.DataFrame({"prediction": k @ f["alpha"] + f["mean"], "std": np.sqrt(np.maximum(var, 1e-12))})

        return df.withColumn("__gp", predict(vector_to_array("features"))).select("*", "__gp.*").drop("__gp")

    def importance(self):
        return [float(x) for x in 1 / self.fitted["scale"]]

    def save(self, path):
        from pyspark.sql import SparkSession

        text = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.fitted.items()})
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def load(self, path):
        from pyspark.sql import SparkSession

        found = json.loads(SparkSession.active().read.text(path).first().value)
        self.fitted = {k: np.array(v) if isinstance(v, list) else v for k, v in found.items()}
        return self


def rbf(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.maximum((x**2).sum(1)[:, None] + (z**2).sum(1) - 2 * x @ z.T, 0))


@register("lstm", "sequence")
class Sequence(Boosting):
    """Windows of past rows, flattened, for a boosted model: Spark has no recurrent networks."""

    kind = "sequence"


def assembled(df: DataFrame, features: list[str], window: str | None = None) -> DataFrame:
    """Add the ``features`` vector from columns, or from a window's nested array."""
    if window:
        return df.withColumn("features", array_to_vector(F.flatten(window)))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def vector(values: list[float]):
    return Vectors.dense(values)
