"""Mixing sources to target weights by a low-discrepancy schedule of equal-sized blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.common import WORD_SQL, slim
from sitelake.llm.tables import ROW, with_rows
from sitelake.session import cut_lineage

#: Words in a block, the unit the schedule deals out.
BLOCK_WORDS = 32
#: The schedule is ranked in runs of so many slots, and mapped to sources through so many equal parts of the unit interval.
RUN_SLOTS, PARTS = 65_536, 1_024
#: Golden-ratio step as a fraction of 2^32; its multiples fill the circle evenly at every length.
STEP, TURN = 1_640_531_527, 1 << 32
#: Rows of a source that one task orders.
SLICE_ROWS = 20_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_SQL)), F.lit(0)).cast("bigint")
    rows = slim(docs, doc_id=id_col, text=text_col, source=source_col, **{ROW: row_col})
    return rows.select("doc_id", "source", words.alias("size"), *([ROW] if row_col else []))


def numbered(sources: DataFrame) -> DataFrame:
    """`source_no`, the place of each source by code point with null last, without one task for all of them."""
    order = F.col("source").asc_nulls_last()
    placed = cut_lineage(
        sources.repartitionByRange(order).sortWithinPartitions(order).select(
            "*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")
        )
    )
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, "part").select("source", "source_size", (F.col("start") + F.col("place")).alias("source_no"))


def source_targets(sizes: DataFrame, cycle: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_no, source_size, target: `share` of all words by weight, no target above `most` times its source.

    Sources take the weights of `cycle` in turn by code point, null last. What is above a limit is reshared by weight among the
    others until none is above; each round is one sum over the sources. Targets may fall short only if all sources are at their limit.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    sources = cut_lineage(
        numbered(totals).withColumn("weight", F.element_at(weights, (F.col("source_no") % len(cycle) + 1).cast("int")))
    )
    limit, weight = F.col("source_size") * most, F.col("weight")
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    wanted = share * (first.words or 0)
    level = wanted / first.weight if first.weight else 0.0
    full = -1
    while True:
        above = limit <= weight * level
        r = sources.agg(
            F.count(F.when(above, 1)).alias("full"), F.sum(F.when(above, limit)).alias("held"), F.sum(F.when(~above, weight)).alias("weight")
        ).first()
        if r.full == full or not r.weight:
            break
        full, level = r.full, (wanted - (r.held or 0.0)) / r.weight
    return sources.select("source", "source_no", "source_size", F.least(limit, weight * level).alias("target"))


def streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place in its source's shuffled stream: source_no and `at`, the words before it.

    A source is ordered by a hash of its ids. The running sum works in slices of the hash, so a source with most rows is spread out.
    """
    named = targets.select(F.col("source").alias("s"), "source_no", "source_size", "target")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("h", F.xxhash64(F.lit("mixing"), "doc_id"))
    bits = max(2, min(20, math.ceil(math.log2(max(1, sizes.count()) / SLICE_ROWS + 1)) + 2))
    rows = rows.withColumn("slice", F.shiftrightunsigned("h", 64 - bits))
    sums = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "slice", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("start"))
    numbers = [ROW] if ROW in sizes.columns else []
    inside = Window.partitionBy("source_no", "slice").orderBy("h", "doc_id", "size", *numbers).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, ["source_no", "slice"]).select(
        "doc_id", "source", "size", "source_no", "source_size", "target", (F.col("start") + F.col("inside")).alias("at"), *numbers
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_no, block: the order in which blocks are dealt, `block` counting the slots of a source from 0.

    Slot i falls on the point frac(i * golden ratio), which belongs to the source whose part of the cumulated targets holds it. A
    source's slots therefore stay within a few blocks of its share over any stretch of the schedule.
    """
    spark = targets.sparkSession
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    n_slots = math.ceil(words / block_words)
    # Cumulated shares; a row for each source.
    upto = Window.orderBy("source_no")
    parts = targets.where("target > 0").select(
        "source_no", ((F.sum("target").over(upto) - F.col("target")) / words).alias("lo"), (F.sum("target").over(upto) / words).alias("hi")
    )
    last = parts.agg(F.max("source_no")).first()[0]
    parts = parts.withColumn("hi", F.when(F.col("source_no") == last, 2.0).otherwise(F.col("hi")))
    cells = parts.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * PARTS), F.least(F.floor(F.col("hi") * PARTS), F.lit(PARTS - 1)).cast("bigint")))
    )
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % TURN) * STEP % TURN / float(TURN)).alias("point")
    ).withColumn("cell", F.floor(F.col("point") * PARTS))
    dealt = slots.join(cells, "cell").where("point >= lo and point < hi").select(
        "slot", "source_no", F.floor(F.col("slot") / RUN_SLOTS).alias("run")
    )
    counts = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    over = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_no", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    return dealt.withColumn("place", place).join(starts, ["source_no", "run"]).select(
        "slot", "source_no", (F.col("start") + F.col("place")).alias("block")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: Sequence[float] = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, row_col: str | None = None,
) -> DataFrame:
    """How many words the mix takes from each document: doc_id, size, source_size, target, taken, source; a row for each input row.

    A source's documents, shuffled by a hash of their ids, form one stream of words, repeated as often as `most` allows and cut into
    blocks of `block_words`. The schedule's k-th slot of a source takes its k-th block. So each source's words come within a few
    blocks of its target, no document gives more than `most` times its size, and a rerun takes the same words.

    Null and empty texts have size 0 and give nothing. A null source is a source of its own. Rows with the same id are ordered by
    size. An empty table gives an empty result. Other columns are left out but
    `row_col`, a number of each row.
    """
    sizes = cut_lineage(sized(docs, id_col, text_col, source_col, row_col))
    targets = cut_lineage(source_targets(sizes, cycle, share, most))
    placed = cut_lineage(streams(sizes, targets))
    slots = schedule(targets, block_words).select("source_no", "block")
    reach = slots.groupBy("source_no").agg(F.max("block").alias("last"))  # a row for each source
    # Times the stream is read, and the words of each reading that the limit allows.
    laps = placed.where("size > 0").join(reach, "source_no").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    begin = F.col("lap") * F.col("source_size") + F.col("at")
    end = F.least(begin + F.col("size"), F.floor(F.col("source_size") * most))
    pieces = (
        laps.select("source_no", "at", "last", begin.alias("begin"), end.alias("end"))
        .where((F.col("end") > F.col("begin")) & (F.floor(F.col("begin") / block_words) <= F.col("last")))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.least(F.floor((F.col("end") - 1) / block_words), "last"))))
    )
    words = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    taken = pieces.withColumn("words", words).join(slots, ["source_no", "block"]).groupBy("source_no", "at").agg(F.sum("words").alias("words"))
    # Among the rows of a source only one with words starts at a given place.
    place = F.when(F.col("size") > 0, F.col("at"))
    return (
        placed.withColumn("place", place).join(taken.withColumnRenamed("at", "place"), ["source_no", "place"], "left")
        .select(
            "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
            F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"), "source", *([F.col(ROW).alias(row_col)] if row_col else []),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents: each row as often as its taken words come to its size, rounded; columns as given.

    Rows are told apart by number, so ids may be null or repeated. Rows without words (null, empty and blank texts) have nothing to
    give and go. An empty table gives an empty result. Columns may have any names.
    """
    held = {name: f"__mixed_{i}" for i, name in enumerate(docs.columns)}
    rows = with_rows(docs.select(*(F.col(f"`{name}`").alias(new) for name, new in held.items())), "mixing")
    copies = mix(rows, held[id_col], held[text_col], held[source_col], row_col=ROW, **options).where("taken > 0").select(
        F.col(ROW).alias("__taken_row"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__copies")
    ).where("__copies > 0")
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")
    return rows.join(copies, F.col(ROW) == F.col("__taken_row")).select(*rows.columns, repeated).select(*(F.col(new).alias(name) for name, new in held.items()))
