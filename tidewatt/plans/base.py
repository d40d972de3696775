"""The contract of steps that learn and transform, and their combination."""

from __future__ import annotations

import copy
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Dataset
from ..operators.splits import Split


class NotFittedError(RuntimeError):
    """A step that learns was used before ``fit``."""


class Step:
    """``fit`` learns, ``transform`` makes a new lazy frame; both take a DataFrame, a Dataset or a Split, of which
    ``fit`` uses the training part. Parameters are those of ``__init__``, kept under their names."""

    stateless = False
    fitted_ = False

    def get_params(self) -> dict:
        return {n: getattr(self, n) for n in list(inspect.signature(type(self).__init__).parameters)[1:]}

    def set_params(self, **params) -> "Step":
        if unknown := params.keys() - self.get_params().keys():
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def clone(self) -> "Step":
        """The same parameters, not fitted."""
        return type(self)(**{k: v.clone() if isinstance(v, Step) else copy.copy(v) for k, v in self.get_params().items()})

    def fit(self, data) -> "Step":
        self._fit(_frame(data.train if isinstance(data, Split) else data))
        self.fitted_ = True
        return self

    def transform(self, data):
        if not (self.fitted_ or self.stateless):
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        if isinstance(data, Split):
            return data.map(self.transform)
        if isinstance(data, Dataset):
            return data.with_data(self._transform(data.df))
        return self._transform(data)

    def fit_transform(self, data):
        return self.fit(data).transform(data)

    def get_report(self, data) -> dict[str, DataFrame]:
        """Lazy reports of what ``transform`` does to ``data``; of each part of a split."""
        if isinstance(data, Split):
            return {n: self.get_report(p) for n, p in data.parts().items()}
        return self._report(_frame(data))

    def _fit(self, df: DataFrame) -> None:
        pass

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _report(self, df: DataFrame) -> dict[str, DataFrame]:
        return {}


def _frame(data) -> DataFrame:
    return data.df if isinstance(data, Dataset) else data


class Function(Step):
    """A step without state from a function of a frame."""

    stateless = True

    def __init__(self, fn, name: str | None = None):
        self.fn, self.name = fn, name

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


class Pipeline(Step):
    """Steps one after another; each is fitted on what those before it make. Repeated names get a number."""

    def __init__(self, steps):
        self.steps = list(steps)

    @property
    def named_steps(self) -> dict[str, Step]:
        out: dict[str, Step] = {}
        for s in self.steps:
            name = getattr(s, "name", None) or type(s).__name__
            n = sum(k == name or k.rsplit("_", 1)[0] == name and k.rsplit("_", 1)[-1].isdigit() for k in out)
            out[f"{name}_{n + 1}" if n else name] = s
        return out

    @property
    def stateless(self) -> bool:  # type: ignore[override]
        return all(s.stateless for s in self.steps)

    def clone(self) -> "Pipeline":
        return Pipeline([s.clone() for s in self.steps])

    def _fit(self, df: DataFrame) -> None:
        for s in self.steps:
            df = s.fit(df).transform(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def _report(self, df: DataFrame) -> dict[str, DataFrame]:
        out = {}
        for n, s in self.named_steps.items():
            out |= {f"{n}.{k}": v for k, v in s.get_report(df).items()}
            df = s.transform(df)
        return out


class PerSeries(Step):
    """Own steps for the series of a keyed frame: ``steps`` by the value of ``key``, and ``default`` for the others, or
    None to leave them as they are. With ``strict`` series without steps are errors, as are steps without series.
    Each step sees its series only; the parts are united again."""

    def __init__(self, key: str, steps: dict, default: Step | None = None, strict: bool = False):
        self.key, self.steps, self.default, self.strict = key, dict(steps), default, strict

    @property
    def stateless(self) -> bool:  # type: ignore[override]
        return all(s.stateless for s in [*self.steps.values(), *([self.default] if self.default else [])])

    def clone(self) -> "PerSeries":
        return PerSeries(self.key, {k: s.clone() for k, s in self.steps.items()}, self.default and self.default.clone(), self.strict)

    def _split(self, df: DataFrame) -> list[tuple[str, Step | None, DataFrame]]:
        if self.key not in df.columns:
            raise ValueError(f"no column {self.key!r} tells the series")
        if self.strict:
            found = {r[0] for r in df.select(self.key).distinct().collect()}
            apart = found.symmetric_difference(self.steps) if self.default is None else self.steps.keys() - found
            if apart:
                raise KeyError(f"series and steps differ in {sorted(map(str, apart))}")
        own = F.col(self.key).isin(list(self.steps))
        rest = df.where(~F.coalesce(own, F.lit(False)))
        return [(str(k), s, df.where(F.col(self.key) == k)) for k, s in self.steps.items()] + [("default", self.default, rest)]

    def _fit(self, df: DataFrame) -> None:
        for _, step, rows in self._split(df):
            if step:
                step.fit(rows)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = None
        for _, step, rows in self._split(df):
            done = step.transform(rows) if step else rows
            out = done if out is None else out.unionByName(done, allowMissingColumns=True)
        return out

    def _report(self, df: DataFrame) -> dict[str, DataFrame]:
        return {f"{name}.{k}": v for name, step, rows in self._split(df) if step for k, v in step.get_report(rows).items()}
