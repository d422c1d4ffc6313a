"""Listings of generated site packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files never packed, at any depth.
EXCLUDED_NAME = r"^(_debug_trace.*\.json|blueprint\.json)$"


def read_package_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring("path", F.instr("path", base) + len(base), F.length("path"))
    return files.select(relative.alias("path"), "length", "modificationTime")


def packaged(listing: DataFrame) -> DataFrame:
    """Files that belong into the package."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing.filter(~name.rlike(EXCLUDED_NAME))
