"""Intermediate tables in the shared folder, and freeing them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.session import Steps

#: Column that numbers the rows of a table.
ROW = "__row"


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """The table with a number for each row, written, so that a row keeps its number however often it is read."""
    return Steps(df.sparkSession, name).write("rows", df.withColumn(ROW, F.monotonically_increasing_id()))


FILTER_FROM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Let Spark test the keys of any scan against a Bloom filter of the other side of a join, before its rows are shuffled.

    Spark bounds the filter's size itself, and the join that follows is exact.
    """
    before = spark.conf.get(FILTER_FROM)
    spark.conf.set(FILTER_FROM, "0")
    try:
        yield
    finally:
        spark.conf.set(FILTER_FROM, before)
