"""Site documents: blueprint JSON, design documents and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake import schemas

# Fixed values.
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
SITEMAP_ROOT = "https://REPLACE-WITH-YOUR-DOMAIN.com/"


def complete(value: Column, kind: T.DataType, name: str = "") -> Column:
    """Fill every missing key of a document with its typed empty value."""
    if isinstance(kind, T.StructType):
        return F.struct(*[complete(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        full = F.coalesce(value, F.array().cast(kind))
        if isinstance(kind.elementType, T.StructType):
            return F.transform(full, lambda item: complete(item, kind.elementType))
        return full
    return value if name in schemas.NULLABLE_TEXT else F.coalesce(value, F.lit(""))


def parse_blueprints(df: DataFrame, column: str = "document") -> DataFrame:
    """Parse document text; unknown keys are ignored and missing ones filled."""
    parsed = df.withColumn("_doc", F.from_json(column, schemas.BLUEPRINT))
    return parsed.withColumn("blueprint", complete(F.col("_doc"), schemas.BLUEPRINT)).drop("_doc")


def read_blueprints(spark: SparkSession, path: str) -> DataFrame:
    """Blueprint documents written by `write_blueprints`, one per line."""
    raw = spark.read.text(path, wholetext=False).withColumnRenamed("value", "document")
    return parse_blueprints(raw)


def write_blueprints(df: DataFrame, path: str) -> None:
    """`host` and `blueprint` columns to JSON lines, the host as a field: a folder per host would be too many small files."""
    df.select("host", "blueprint.*").repartition("host").sortWithinPartitions("host").write.mode("overwrite").json(path)


def write_design_documents(df: DataFrame, path: str) -> None:
    """`host` and `design_md` columns to a table clustered by host."""
    df.select("host", "design_md").repartition("host").sortWithinPartitions("host").write.mode("overwrite").parquet(path)


#: Addresses in one sitemap, the format's own limit.
SITEMAP_FILES = 50_000


def sitemaps(pages: DataFrame) -> DataFrame:
    """One sitemap text per site and `SITEMAP_FILES` pages, from rows of site, page_no and file."""
    entries = F.transform(
        F.array_sort(F.collect_list("file")), lambda f: F.concat(F.lit(f"  <url><loc>{SITEMAP_ROOT}"), f, F.lit("</loc></url>"))
    )
    text = F.concat(F.lit(SITEMAP_HEAD), F.array_join(entries, "\n"), F.lit("\n</urlset>\n"))
    part = F.floor(F.col("page_no") / SITEMAP_FILES).cast("int").alias("part")
    return pages.groupBy("site", part).agg(text.alias("sitemap"))


def write_sitemaps(df: DataFrame, path: str) -> None:
    """`site`, `part` and `sitemap` columns to a table clustered by site."""
    df.select("site", "part", "sitemap").repartition("site").sortWithinPartitions("site", "part").write.mode("overwrite").parquet(path)
