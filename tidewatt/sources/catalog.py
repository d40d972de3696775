"""Named datasets, kept in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frame import Dataset
from .tables import load_table

_known: dict[str, tuple[str, object, str | None]] = {}


def register_dataset(name: str, path: str, spec=None, description: str | None = None, overwrite: bool = False) -> None:
    """Names don't depend on case; a taken one raises KeyError unless it is overwritten."""
    if name.lower() in _known and not overwrite:
        raise KeyError(f"dataset {name!r} is there already")
    _known[name.lower()] = (path, spec, description)


def list_datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, p, d) for n, (p, _, d) in sorted(_known.items())], "name string, path string, description string")


def load_dataset(spark: SparkSession, name: str, **options) -> Dataset:
    if name.lower() not in _known:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_known)}")
    path, spec, _ = _known[name.lower()]
    if path.endswith(".parquet"):
        return load_table(spark, spark.read.parquet(path), spec=spec, name=name, **options)
    return load_table(spark, path, spec=spec, name=name, **options)
