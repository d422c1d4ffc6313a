"""Collocations: frequent phrases whose words come together more often than their parts would, by language.

Texts become blocks of word numbers once. A phrase of L words is a pair: the number of its first L - 1 words and the number of its last
word. Numbers are ranks by frequency, so pairs fall in square tiles of which those of frequent numbers are nearly full: these are
counted with one bincount over the tile's cells, all others as sorted coordinates. Frequent pairs are ranked in turn, and their ranks
are the first numbers of the next length, until the longest. A phrase can only be frequent if both phrases one word shorter are, so
nothing is lost by leaving the rest out.

Blocks never meet a table of all words: each lists its own words, the lists join the ranks, and what they found goes back to the block
as sorted rows, one block at a time. Written blocks lie in small groups of rows, so no task holds more than a few.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim
from sitelake.llm.tables import Steps, runtime_filters

#: Bytes of text in a block; it only sets the size of the pieces of work.
BLOCK_BYTES = 4_000_000
#: Bytes of written blocks that a task holds at a time.
GROUP_BYTES = 8_000_000
#: Blocks that a task meets with what was found for them: it sorts both sides, and a sort that has spilled keeps what it holds from the other.
MET = 4
#: Side of a tile, and the pairs from which its cells are counted directly.
TILE, DENSE = 256, 256 * 256 // 8
BREAK = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)
SEPARATOR = re.compile(BREAK)


class Numbers(dict):
    """Numbers of the words of a block in order of appearance; a break is -1."""

    def __init__(self) -> None:
        super().__init__({BREAK: -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1
        return n


def chunks(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about a block, cut at breaks."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        found = SEPARATOR.search(data, at + BLOCK_BYTES)
        if not found:
            break
        yield data[at : found.start()]
        at = found.end()
    yield data[at:]


def token_blocks(docs: DataFrame) -> DataFrame:
    """block, lang, words, counts, codes (32-bit places in `words`, -1 for breaks between pieces and texts)."""
    ddl = "block bigint, lang string, words array<string>, counts array<bigint>, codes binary"
    out = arrow_schema(ddl)

    def coded(block: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        numbers = Numbers()
        found = BREAK.join(texts).replace(BREAK, b" \xff ").split()
        codes = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
        counts = np.bincount(codes[codes >= 0], minlength=len(numbers) - 1)
        words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
        whole = pa.array([0, len(words)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(whole, words).cast(out.field("words").type),
                pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())).cast(out.field("counts").type), pa.array([codes.tobytes()], pa.binary()),
            ],
            schema=out,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sizes = TaskContext.get().partitionId() << 32, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for data in chunks((text.as_py() or b"").translate(TABLE)):
                    held.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data)
                    while sizes and sum(sizes.values()) > BLOCK_BYTES:  # the largest goes first, so that many small languages wait together
                        largest = max(sizes, key=sizes.get)
                        yield coded(block, largest, held.pop(largest))
                        sizes.pop(largest)
                        block += 1
        for lang, texts in held.items():
            yield coded(block, lang, texts)
            block += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, ddl)


def ranked(df: DataFrame, steps: Steps, name: str, ties: list[str]) -> DataFrame:
    """The rows with `id`: their rank within the language, from 0, by falling f, then `ties`.

    Rows are dealt out by ranges of that order; each takes its place in its range plus the sizes of the ranges before it.
    """
    order = ["lang", F.desc("f"), *ties]
    rows = steps.write(
        f"{name}-sorted", df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    rows = rows.withColumn("range", F.shiftright("place", 33))
    ranges = rows.groupBy("lang", "range").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("lang", "range", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    found = steps.write(name, rows.join(ranges, ["lang", "range"]).withColumn("id", F.col("place") + F.col("shift")).drop("place", "range", "shift"))
    steps.drop(f"{name}-sorted")
    return found


def narrow(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() > np.iinfo(np.int32).max:
        raise ValueError("a language has more frequent phrases of one length than 32 bits can number")
    return ids.astype(np.int32)


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two arrays of numbers, and how often each comes: full tiles by bincount, the rest as sorted coordinates."""
    if not len(a):
        return a, b, a
    side = int(b.max()) // TILE + 1
    tiles = (a // TILE) * side + b // TILE
    found, inverse, sizes = np.unique(tiles, return_inverse=True, return_counts=True)
    out = []
    for tile in np.flatnonzero(sizes >= DENSE):
        inside = inverse == tile
        counts = np.bincount((a[inside] % TILE) * TILE + b[inside] % TILE, minlength=TILE * TILE)
        cells = np.flatnonzero(counts)
        row, column = divmod(int(found[tile]), side)
        out.append((row * TILE + cells // TILE, column * TILE + cells % TILE, counts[cells]))
    sparse = sizes[inverse] < DENSE
    codes, counts = np.unique((a[sparse] << 32) | b[sparse], return_counts=True)
    out.append((codes >> 32, codes & 0xFFFFFFFF, counts))
    return tuple(np.concatenate(c) for c in zip(*out))


def pair_places(heads: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a frequent phrase of length - 1 words and a frequent word after it begin, and the numbers of both."""
    tails = ids[length - 1 :]
    at = np.flatnonzero((heads[: len(tails)] >= 0) & (tails >= 0))
    return at, heads[at].astype(np.int64), tails[at].astype(np.int64)


def word_numbers(blocks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """block, lang, ids: the blocks in ranks of words, -1 for breaks and words that are not in the lexicon."""
    places = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    found = places.join(lexicon.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("owner"), "place", "id")
    ddl = "block bigint, lang string, ids binary"
    out = arrow_schema(ddl)

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        if not (block.num_rows and known.num_rows):
            return out.empty_table()
        table = np.full(block.column("n")[0].as_py() + 1, -1, np.int32)  # the last entry is for breaks
        table[known.column("place").to_numpy()] = narrow(known.column("id").to_numpy())
        ids = table[np.frombuffer(block.column("codes")[0].as_py(), np.int32)]
        return pa.Table.from_arrays([block.column("block"), block.column("lang"), pa.array([ids.tobytes()], pa.binary())], schema=out)

    whole = blocks.select("block", "lang", "codes", F.size("words").alias("n"))
    return met(whole, found, run, ddl)


def met(blocks: DataFrame, found: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """`run` for each block and the rows found for it (by `owner`), a few blocks in a task whatever their number."""
    tasks = blocks.count() // MET + 1
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "owner").groupBy("owner")).applyInArrow(run, ddl)


def pair_cells(coded: DataFrame, length: int) -> DataFrame:
    """block, lang, pair, n: pairs in each block, as `a` and `b` in 32 bits each: joins sort and filter by one number. `coded` has block, lang,
    ids and, beyond two words, heads."""
    ddl = "block bigint, lang string, pair bigint, n bigint"
    out = arrow_schema(ddl)
    heads_in = "heads" if length > 2 else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, heads, ids in zip(*(batch.column(c) for c in ("block", "lang", heads_in, "ids"))):
                _, a, b = pair_places(np.frombuffer(heads.as_py(), np.int32), np.frombuffer(ids.as_py(), np.int32), length)
                a, b, n = count_pairs(a, b)
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(block, len(a)), pa.repeat(lang, len(a)), pa.array((a << 32) | b, pa.int64()), pa.array(n, pa.int64())], schema=out
                    )

    return coded.mapInArrow(run, ddl)


def phrase_numbers(coded: DataFrame, cells: DataFrame, phrases: DataFrame, length: int) -> DataFrame:
    """The blocks with `heads`: at each place the rank of the frequent phrase of `length` words that begins there, or -1."""
    named = phrases.where("f > 0").select("pair", "lang", "id")  # the condition holds for all; Spark filters cells only by a side that has one
    found = cells.drop("n").join(named, ["pair", "lang"]).select(F.col("block").alias("owner"), "pair", "id")
    ddl = "block bigint, lang string, ids binary, heads binary"
    out = arrow_schema(ddl)
    heads_in = "heads" if length > 2 else "ids"

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        if not (block.num_rows and known.num_rows):
            return out.empty_table()
        heads, ids = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in (heads_in, "ids"))
        codes, number = (known.column(c).to_numpy() for c in ("pair", "id"))
        order = np.argsort(codes)
        codes, number = codes[order], number[order]
        at, a, b = pair_places(heads, ids, length)
        wanted = (a << 32) | b
        spot = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        hit = codes[spot] == wanted
        longer = np.full(len(ids), -1, np.int32)
        longer[at[hit]] = narrow(number[spot[hit]])
        return pa.Table.from_arrays([block.column(c) for c in ("block", "lang", "ids")] + [pa.array([longer.tobytes()], pa.binary())], schema=out)

    return met(coded, found, run, ddl)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled, wide(left) * wide(right))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, covered: int = 50, top: int = 2_000) -> DataFrame:
    """The first `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l, r: occurrences of the phrase and of the two parts of its weakest cut; n: all words of the language. Phrases occur at least
    `least` times; one that lies in a longer such phrase with at least `covered` hundredths of its occurrences is dropped. Order: score
    falling, a falling, phrase by bytes. Ranks and scores are exact.

    Null texts are empty; texts without words, or only short ones, add to n alone. A null language is `und`. Repeated rows count each
    time. A language without frequent phrases has no rows, an empty table gives an empty result; other columns are left out. A text is
    cut into blocks at its breaks, so no task holds more than a block and one piece.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "collocations")
    blocks = steps.write("blocks", token_blocks(slim(docs, lang=lang_col, text=text_col)), GROUP_BYTES)
    total = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    total = steps.write("total", total)
    words = blocks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    lexicon = ranked(words.where(F.col("f") >= least), steps, "lexicon", ["word"])
    coded = steps.write("coded", word_numbers(blocks, lexicon), GROUP_BYTES)
    steps.drop("blocks")

    none = F.array().cast("array<bigint>")
    shorter = lexicon.select("lang", "id", "f", F.array("word").alias("words"), none.alias("before"), none.alias("after"), F.lit(-1).cast("bigint").alias("a"), F.col("id").alias("b"), F.lit(-1).cast("bigint").alias("rest"))
    found, unused = None, lexicon
    for length in range(2, longest + 1):
        cells = pair_cells(coded, length)
        if length < longest:
            cells = steps.write(f"cells-{length}", cells)
        frequent = cells.groupBy("pair", "lang").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        frequent = ranked(frequent, steps, f"pairs-{length}", ["pair"])
        if length < longest:
            with runtime_filters(spark):
                following = steps.write(f"coded-{length}", phrase_numbers(coded, cells, frequent, length), GROUP_BYTES)
            steps.drop("coded" if length == 2 else f"coded-{length - 1}", f"cells-{length}")
            coded = following
        phrases = steps.write(f"phrases-{length}", described(frequent, shorter, lexicon, length))
        if length > 2:
            held = phrases.select("lang", F.explode(F.array("a", "rest")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("longer"))
            shorter = shorter.join(held, ["lang", "id"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True))).drop("longer")
            found = shorter if found is None else found.unionByName(shorter)
        shorter = phrases
    found = shorter if found is None else found.unionByName(shorter)
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("before")),
        lambda k: F.struct(
            cut_score(F.col("f"), F.element_at("before", k), F.element_at("after", k)).alias("score"), k.alias("k"),
            F.element_at("before", k).alias("l"), F.element_at("after", k).alias("r"),
        ),
    )
    scored = found.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # at most `top` rows a language leave a task
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def described(frequent: DataFrame, shorter: DataFrame, lexicon: DataFrame, length: int) -> DataFrame:
    """Phrases with their words, the occurrences of what lies before and after each cut, and `rest`, the phrase without its first word."""
    head = shorter.select("lang", F.col("id").alias("a"), F.col("f").alias("head_f"), F.col("words").alias("head_words"), F.col("before").alias("head_before"), F.col("rest").alias("head_rest"))
    last = lexicon.select("lang", F.col("id").alias("b"), "word")
    parts = frequent.select("lang", "id", "f", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"))
    rows = parts.join(head, ["lang", "a"]).join(last, ["lang", "b"])
    if length == 2:
        tail = shorter.select("lang", "b", F.col("id").alias("rest"), F.col("f").alias("rest_f"), F.col("after").alias("rest_after"))
        rows = rows.join(tail, ["lang", "b"])
    else:
        tail = shorter.select("lang", F.col("a").alias("head_rest"), "b", F.col("id").alias("rest"), F.col("f").alias("rest_f"), F.col("after").alias("rest_after"))
        rows = rows.join(tail, ["lang", "head_rest", "b"])
    return rows.select(
        "lang", "id", "f", F.concat("head_words", F.array("word")).alias("words"), F.concat("head_before", F.array("head_f")).alias("before"),
        F.concat(F.array("rest_f"), "rest_after").alias("after"), "a", "b", "rest",
    )
