"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: texts are long, and Spark's default of 10,000 rows a batch is not."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32(doc_id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: Iterable[tuple[str, T.DataType]], keep: Iterable[str] | None = None) -> DataFrame:
    """Add columns computed by ``fn`` from record batches.

    ``fn`` returns one sequence for each of ``fields``. Columns of ``df`` with those names are replaced;
    of the others ``keep`` stay (default: all). Rows keep their order and number.
    """
    fields = list(fields)
    new = [n for n, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for b in batches:
            made = fn(b)
            cols = [b.column(c) for c in kept] + [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, out.field(n).type) for n, m in zip(new, made, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
