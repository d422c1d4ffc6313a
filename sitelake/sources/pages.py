"""Page corpora: tables, loose HTML trees and crawl manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake import schemas
from sitelake.session import checkpoint_folder


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_html_tree(spark: SparkSession, path: str) -> DataFrame:
    """Loose `.html` files below a folder, one row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    return files.select("path", "length", "modificationTime", F.decode("content", "UTF-8").alias("html"))


def read_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Crawl manifests, one JSON document per file (or per line); unreadable ones keep their text in `_corrupt`."""
    return (
        spark.read.schema(schemas.MANIFEST).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )


def manifest_pages(manifests: DataFrame) -> DataFrame:
    """Pages with their number in the site; a manifest that is one part of a site says with `first_page` where it begins."""
    listed = manifests.select("project_id", F.coalesce("first_page", F.lit(0)).alias("first"), F.posexplode("pages").alias("at", "p"))
    return listed.select("project_id", (F.col("first") + F.col("at")).alias("page_no"), "p.*")


def manifest_assets(manifests: DataFrame) -> DataFrame:
    return manifests.select("project_id", F.posexplode("assets").alias("seq", "a")).select("project_id", "seq", "a.*")


def bucketed_pages(pages: DataFrame, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """The pages as a table bucketed by `page_id`, so that later joins on it leave the page bodies where they are.

    Writing deals rows into files without a shuffle. The number of buckets is the session's number of shuffle partitions by default;
    with another one, Spark may move the bodies after all.
    """
    spark = pages.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pages_{uuid.uuid4().hex}"
    path = folder or f"{checkpoint_folder(spark)}/{name}"
    pages.write.bucketBy(n, "page_id").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
