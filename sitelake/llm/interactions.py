"""Interaction audit of document filters: what each filter removes in each order of applying them, by part of the corpus.

Whatever the order, a document's fate depends only on the set of filters it fails: its mask, one of 32 cells. So documents are counted
by part and cell first. A recursive query enumerates the orders: a prefix of applied filters is extended by every filter it has not
used, each extension meets every cell, and the applied bits it carries tell whether the step removes, keeps or misses the cell's
documents. Its 10,400 rows do not depend on the data, which bounds their broadcast; the counts then join them by cell.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.llm.common import WORD_SQL
from sitelake.llm.tables import Steps

LETTERS = "ABCDE"
#: More filters than this have too many orders to list.
MOST_LETTERS = 6
COUNTS = ("n", "n_good", "n_toxic")


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D: few words, few distinct words, many capitals, a symbol."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_SQL})"))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: documents by source and set of failed filters (bit 0 for A to bit 4 for E).

    A null source is the part of the empty one; null texts are empty texts. Only digests of the texts are shuffled, and texts are read once. E: all rows of a
    text fail but those of its smallest id and those without id, in whatever part. Copies are combined by text, part and mark before
    the smallest ids meet them. A label holds if any row of the id has it; rows without id have none. Other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(failures(text))), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"))
    steps = Steps(docs.sparkSession, "interactions")
    rows = steps.write("rows", rows.groupBy("doc_id", "part", "mask", "same").agg(F.count("*").alias("n")))
    has = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    unknown = rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    key = ["same", "part", "mask", "good", "toxic"]
    cells = steps.write("cells", known.unionByName(unknown).groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.max("doc_id").alias("last_id"),
    ))
    steps.drop("rows")
    copied = cells.groupBy("same").agg(F.min("first.doc_id").alias("first_id"), F.max("last_id").alias("last_id")).where("first_id < last_id")
    met = cells.drop("last_id").join(copied.drop("last_id"), "same", "left")
    kept_ids = F.when(F.col("first.doc_id") == F.col("first_id"), F.col("first.n")).otherwise(0)
    late = F.when(F.col("first_id").isNull(), 0).otherwise(F.col("n") - F.col("n_unknown") - kept_ids)
    split = F.explode(F.array(F.struct(F.lit(0).alias("bit"), (F.col("n") - late).alias("n")), F.struct(F.lit(16).alias("bit"), late.alias("n"))))
    parted = met.select("part", "mask", "good", "toxic", split.alias("half")).where("half.n > 0")
    n = F.col("half.n")
    return parted.groupBy("part", (F.col("mask") + F.col("half.bit")).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("n_good"), F.sum(n * F.col("toxic")).alias("n_toxic")
    )


def prefix_cells(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """prefix, step, letter, mask and how the step meets the mask: `fails`, `removed`, `kept`, `redundant`, `alone` (it fails no other).

    One recursion level per step; a prefix of k filters extends to one of k + 1 by each letter not in it.
    """
    if not 1 <= len(letters) <= MOST_LETTERS or len(set(letters)) != len(letters) or not letters.isalpha():
        raise ValueError(f"between 1 and {MOST_LETTERS} distinct letters name the filters")
    return spark.sql(f"""
        with recursive steps (prefix, step, letter, bit, before, mask) as (
            select '', 0, '', 0, 0, cast(id as int) from range({1 << len(letters)})
            union all
            select concat(prefix, next), step + 1, next, 1 << place, before | bit, mask
            from steps lateral view posexplode(split('{",".join(letters)}', ',')) as place, next
            where step < {len(letters)} and instr(prefix, next) = 0
        )
        select prefix, step, letter, mask, (mask & bit) > 0 as fails, (mask & bit) > 0 and (mask & before) = 0 as removed,
            (mask & (before | bit)) = 0 as kept, (mask & bit) > 0 and (mask & before) > 0 as redundant, mask = bit as alone
        from steps where step > 0
    """)


def interaction_audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters, and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `cells` has part, mask, n, n_good, n_toxic, once per part and mask. Cells without documents may be missing; a part without any cell
    has no rows, so an empty table gives an empty result. `shapley` is what the step's filter removes, summed over all orders.
    """
    steps = prefix_cells(cells.sparkSession, letters)
    total = lambda c, test: F.sum(F.when(F.col(test), F.col(c)).otherwise(0))
    metrics = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"),
        total("n", "alone").alias("unique_fails"), total("n_good", "removed").alias("good_lost"), total("n_toxic", "removed").alias("toxic_lost"),
    )
    # Orders that begin with the prefix.
    begun = F.element_at(F.array(*(F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1))), F.col("step"))
    by_filter = Window.partitionBy("part", "letter")  # a fixed number of prefixes
    metrics = metrics.withColumn("shapley", F.sum(F.col("removed") * begun).over(by_filter)).drop("step", "letter")
    orders = steps.where((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    )
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return metrics.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
