"""Publishing models as views or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEV_SUFFIX = "_dev"


def target_database(database: str, dev: bool = False) -> str:
    return database + DEV_SUFFIX if dev else database


def publish_views(models: dict[str, DataFrame]) -> None:
    """Each model as a temporary view of its name."""
    for name, table in models.items():
        table.createOrReplaceTempView(name)


def publish_tables(
    models: dict[str, DataFrame],
    database: str,
    dev: bool = False,
    partition_by: dict[str, str] | None = None,
) -> None:
    """Each model as a table of the production or development database.

    ``partition_by`` names the partition column of a model, such as the date
    of a daily report.
    """
    target = target_database(database, dev)
    for name, table in models.items():
        writer = table.write.mode("overwrite").format("parquet")
        column = (partition_by or {}).get(name)
        if column is not None:
            writer = writer.partitionBy(column)
        writer.saveAsTable(f"{target}.{name}")


def read_model(spark: SparkSession, name: str, database: str, dev: bool = False) -> DataFrame:
    return spark.table(f"{target_database(database, dev)}.{name}")
