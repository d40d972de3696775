"""Tables written to the folder that all executors share, to cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster, whose
    executors would each write to their own disk."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewatt-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result survives the loss of executors and does not recompute ``df``. An empty ``df`` gives an
    empty table of the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if str(path).startswith((shared_dir(spark), shared_dir(spark).replace("file://", "file:"))):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
