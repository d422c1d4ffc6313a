"""Application tables, append-only ledgers and event sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelake import schemas
from sitelake.operators.costs import with_cost


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.APP_TABLES[name]).parquet(f"{root}/{name}")


def read_jdbc(
    spark: SparkSession, url: str, name: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Parallel range reads of one table; needs a JDBC driver on the classpath."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=str(partitions), **options
    ).load()


def append_usage(usage: DataFrame, pricing: DataFrame, path: str) -> None:
    """Price usage rows once, when they are written, and append them; written rows never change."""
    priced = with_cost(usage, pricing).withColumnRenamed("cost_usd", "cost_estimate_usd").drop("priced")
    priced.write.mode("append").parquet(path)


def read_payment_events(spark: SparkSession, path: str) -> DataFrame:
    """Payment events as JSON lines; the free-shape resource stays text."""
    return spark.read.schema(schemas.PROVIDER_EVENT).json(path)


def stream_payment_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.PROVIDER_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.APP_TABLES["submissions"]).parquet(path)


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.APP_TABLES["submissions"]).parquet(path)
