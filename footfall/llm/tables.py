"""The given tables, intermediate ones, and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.sources import staging


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read more than once, and read it from there.

    It goes to the shared folder, where the lineage ends; a ``staging_run`` around the
    caller removes it at its end.
    """
    return staging.stage(df, name, "zstd")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to differ from the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """Its columns, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def as_row(df: DataFrame) -> Column:
    """All its columns as one struct ``row``, which Python functions can hand through."""
    return F.struct(*columns_of(df)).alias("row")


def from_row(df: DataFrame, names: list[str]) -> list[Column]:
    return [df["row"].getField(name).alias(name) for name in names]
