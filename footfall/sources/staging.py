"""Written intermediate tables.

A table that several later steps read is written once, which also cuts the
lineage: after an executor is lost nothing before the table is computed again.
Tables go below ``spark.checkpoint.dir``, the shared folder the cluster names, or
below the warehouse, which is shared as well, where none is named.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_RUN: ContextVar[str | None] = ContextVar("staging_run", default=None)


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path of its own below the shared folder."""
    return f"{staging_root(spark)}/footfall/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging_run(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside are removed at the end.

    Write the result inside as well: it may read the tables.
    """
    folder = new_folder(spark)
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and return it as read from there."""
    spark = df.sparkSession
    run = _RUN.get()
    path = f"{run}/{uuid.uuid4().hex}/{name}" if run else f"{new_folder(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
