"""Removal of repeated passages by longest-previous-factor values in suffix order.

Two equal strings of `length` bytes have the same least hash among their grams of `gram_of(length)` bytes. Consecutive starts with the same least
hash form a run, whose text is its starts' strings together. All starts that may match share the hash of their run, so suffixes are
sorted only among the distinct texts of runs with one hash: those are cut out once, from the first place where each is found.

In suffix order, equal strings stand together: a stretch in which neighbours share at least `length` bytes. The longest earlier match
of a start reaches `length` exactly if its stretch holds a smaller position (the nearer of its previous and next smaller positions
shares as much with it), and a match anywhere if the stretch holds any other position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim
from sitelake.llm.jaccard import groups_of, in_blocks
from sitelake.llm.tables import Steps

#: Distinct runs of one hash, and bytes of runs, that a task sorts at a time.
GROUP_RUNS, SORT_BYTES = 4_096, 1_000_000
TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([c])) for c in range(256)], np.uint64)
STEP, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

FACTORS = {1 << i: np.uint64(0x9E3779B97F4A7C15 * (2 * (1 << i) + 1) % (1 << 64)) for i in range(20)}


def gram_of(length: int) -> int:
    """Bytes of a gram: a power of two, at most half of `length`, so that a run's least hash stays the same over many starts."""
    return 1 << ((length // 2).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes at each place, by doubling; the last gram - 1 places are left out."""
    h, width = TABLE[data], 1
    while width < gram:
        h = h[:-width] * FACTORS[width] + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= FINISH
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, start, starts, least hash, again) for each run of the texts, which are hashed together.

    `again` is 1 if the run has its least hash at several places, without which no two of its own strings are equal.
    """
    whole = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(whole) < length:
        return
    gram = gram_of(length)
    grams, width = gram_hashes(whole, gram), length - gram + 1
    least = sliding_least(grams, width)  # for each start of a string of `length` bytes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = np.arange(len(least)) + length <= ends[text]
    cut = np.flatnonzero((least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])) + 1
    begins = np.concatenate([[0], cut])
    counts = np.diff(np.concatenate([begins, [len(least)]]))
    kept = valid[begins]
    begins, counts = begins[kept], counts[kept]
    owners = text[begins]
    m = least[begins]
    again = [int(np.count_nonzero(grams[b : b + c - 1 + width] == v) > 1) for b, c, v in zip(begins.tolist(), counts.tolist(), m)]
    yield from zip(owners.tolist(), (begins - (ends - sizes)[owners]).tolist(), counts.tolist(), m.view(np.int64).tolist(), again)


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """m (least hash), sk (hash of the run's text), doc_id, row, start, starts, again for each run of each row."""
    ddl = "m bigint, sk bigint, doc_id bigint, row bigint, start bigint, starts bigint, again bigint"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            texts = [t.as_py() or b"" for t in batch.column("text")]
            at, found = 0, []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SORT_BYTES):
                    size += len(texts[end])
                    end += 1
                for i, start, starts, m, again in runs_of(texts[at:end], length):
                    data = texts[at + i][start : start + starts - 1 + length]
                    found.append((m, xxhash.xxh3_64_intdigest(data) - (1 << 63), ids[at + i], keys[at + i], start, starts, again))
                at = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)

    return docs.mapInArrow(run, ddl)


def stretches(datas: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of all starts of the given run texts: (run, offset) by order, number and least position of each start's stretch.

    Suffixes are compared by the names (hashes) of their grams at each whole gram and of the last gram within `length`. Positions count
    through the runs as given, so equal suffixes stand by position.
    """
    whole = np.frombuffer(b"".join(datas), np.uint8)
    gram = gram_of(length)
    names = gram_hashes(whole, gram)
    sizes = np.array([len(d) for d in datas], np.int64)
    firsts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    run = np.repeat(np.arange(len(datas)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = firsts[run] + offset
    places = sorted({*range(0, length - gram + 1, gram), length - gram})
    keys = [names[at + p] for p in places]
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    tied = np.zeros(len(order), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    where = np.flatnonzero(tied)
    rows = order[where]
    order[where] = rows[np.lexsort([rows, *(k[rows] for k in reversed(keys))])]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    stretch = np.cumsum(new) - 1
    least = order[new][stretch]  # stable: the first of a stretch has its least position
    return order, stretch, least, np.stack([run, offset])


def matches(datas: list[bytes], length: int, later: bool) -> list[tuple[int, int, int]]:
    """(run, first, last offset) of the starts that match elsewhere, or only of those that match earlier, as intervals."""
    order, stretch, least, places = stretches(datas, length)
    if later:
        hit = order != least
    else:
        hit = np.bincount(stretch)[stretch] > 1
    flags = np.zeros(len(order) + 2, np.int8)
    flags[1 + order[hit]] = 1
    inside = flags[1:-1].astype(bool)
    run, offset = places
    if not inside.any():
        return []
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (run[1:] == run[:-1]))
    finish = inside.copy()
    finish[:-1] &= ~(inside[1:] & (run[1:] == run[:-1]))
    b, e = np.flatnonzero(begin), np.flatnonzero(finish)
    return list(zip(run[b].tolist(), offset[b].tolist(), offset[e].tolist()))


def repeated_spans(docs: DataFrame, steps: Steps, length: int = 400, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, text) that may repeat something, and spans (row, lo, hi): bytes of each that repeated strings cover.

    `docs` has doc_id, row (a hash of id and text) and text as bytes. With `keep_first` a string's first place, by id, then place in
    the text, is not covered by it; else all places are.
    """
    runs = steps.write("runs", run_rows(docs, length))
    shared = runs.groupBy("m").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again > 0").select("m")
    met = steps.write("met", runs.join(shared, "m"))
    steps.drop("runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start", "starts")
    kinds = met.groupBy("m", "sk").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(place).alias("first"))
    kinds = steps.write("kinds", kinds)
    several = kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.max("again").alias("again")).where("kinds > 1 or again > 0").drop("again")
    touched = steps.write("touched", docs.join(met.select(F.col("row").alias("r")).distinct(), F.col("row") == F.col("r")).drop("r"))
    # What to cut out, listed by text: its own runs only.
    wanted = kinds.join(several, "m").select("m", "sk", "kinds", "first").groupBy(F.col("first.row").alias("r")).agg(
        F.collect_list(F.struct("m", "sk", "kinds", "first")).alias("cuts")
    )
    ddl = "m bigint, sk bigint, kinds bigint, last boolean, doc_id bigint, row bigint, start bigint, data binary"
    cut_schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist()):
                data = text.as_py()
                for c in cuts:
                    f = c["first"]
                    found.append((c["m"], c["sk"], c["kinds"], f["last"], f["doc_id"], f["row"], f["start"], data[f["start"] : f["start"] + f["starts"] - 1 + length]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), cut_schema)], schema=cut_schema)

    once = touched.dropDuplicates(["row"])
    cuts = once.join(wanted, F.col("row") == F.col("r")).select("text", "cuts").mapInArrow(cut, ddl)
    pieces = in_blocks(cuts.withColumn("a", F.col("sk")), F.col("kinds"), GROUP_RUNS).drop("a", "kinds")
    found_ddl = "m bigint, sk bigint, lo bigint, hi bigint"
    found_schema = arrow_schema(found_ddl)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            hits = matches([h[2] for h in held], length, keep_first)
            rows = [(held[i][0], held[i][1], lo, hi) for i, lo, hi in hits]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=found_schema) if rows else None

        for group in groups_of(batches, ("m", "part"), ("last", "doc_id", "row", "start", "m", "sk", "data")):
            group.sort(key=lambda g: (g[0], g[1] or 0, g[2], g[3]))
            if held and held[-1][0] == group[0][4]:  # parts of one hash share runs, which must not meet themselves
                size = 0
                if (out := flush()) is not None:
                    yield out
            held += [g[4:] for g in group]
            size += sum(len(g[6]) for g in group)
            if size > SORT_BYTES:
                size = 0
                if (out := flush()) is not None:
                    yield out
        if held and (out := flush()) is not None:
            yield out

    # Some of the runs of a hash may match; those of different hashes cannot, so whole groups are sorted together.
    sorted_hits = pieces.repartition("m", "part").sortWithinPartitions("m", "part").mapInArrow(sort, found_ddl)
    hits = steps.write("hits", sorted_hits.groupBy("m", "sk").agg(F.collect_set(F.struct("lo", "hi")).alias("hits")))
    places = met.join(kinds.select("m", "sk", "n", "first"), ["m", "sk"]).join(hits, ["m", "sk"], "left")
    own = (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))
    whole = ~own if keep_first else F.col("n") > 1
    all_starts = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("starts") - 1).alias("hi")))
    spans = places.select(
        "row", "start", F.explode(F.when(whole, all_starts).otherwise(F.coalesce("hits", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))).alias("hit")
    ).select("row", (F.col("start") + F.col("hit.lo")).alias("lo"), (F.col("start") + F.col("hit.hi") + length).alias("hi"))
    return touched, spans


def covered(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.col("row").alias("r")).agg(F.collect_set(F.struct("lo", "hi")).alias("covered"))


def reported(docs: DataFrame, steps: Steps, report: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may repeat a string of `length` bytes, and (r, n_repeated) for each row that repeats one of `report` bytes.

    What a longer string covers is covered by shorter ones too, so rows without `length` bytes in one stretch repeat none of them.
    """
    touched, spans = repeated_spans(docs, steps, report)
    ddl = "r bigint, n_repeated bigint, longest bigint"
    out = arrow_schema(ddl)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, spans in zip(batch.column("r").to_pylist(), batch.column("covered").to_pylist()):
                sizes = [hi - lo for lo, hi in merged([(c["lo"], c["hi"]) for c in spans])]
                found.append((row, sum(sizes), max(sizes)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)

    measured = steps.write("measured", covered(spans).mapInArrow(measure, ddl))
    steps.drop("met", "kinds", "hits")
    long = measured.where(F.col("longest") >= length)
    rows = steps.write("long", touched.join(long, F.col("row") == F.col("r"), "left_semi"))
    steps.drop("touched")
    return rows, measured.drop("longest")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def whole_letters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of letters that reach over their ends."""
    out = []
    for lo, hi in spans:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_first: bool = True, texts: bool = True,
    carry: Sequence[str] = (), report: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) and, with `texts`, kept_text.

    Every byte covered by a string of `length` bytes (at least 16) that is found elsewhere is removed, overlaps included; with
    `keep_first` the first place of each string keeps it. Strings are judged on the input. Spans given with kept_text are cut to whole
    letters. Null and empty texts have no bytes; texts shorter than `length` lose none. A null id comes after all others. Rows with
    equal id and text are other places of their strings and lose alike, but count as one place for `keep_first`. Other columns are
    left out but those named in `carry`, which follow under their own names; an empty table gives an empty result.

    With `report` (16 to `length`), n_repeated follows spans: the bytes covered by strings of `report` bytes found elsewhere, all places
    counted, which tells of passages too short to be removed.
    """
    if report is not None and not 16 <= report <= length:
        raise ValueError("report must be from 16 to length")
    steps = Steps(docs.sparkSession, "suffixes")
    held = {f"carried_{i}": name for i, name in enumerate(carry)}
    given = slim(docs, doc_id=id_col, text=text_col, **held).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *held
    )
    rows = given.select("doc_id", "row", "text")
    if report is not None:
        before = Steps(docs.sparkSession, "reported")
        rows, repeated = reported(rows, before, report, length)
    touched, spans = repeated_spans(rows, steps, length, keep_first)
    by_row = covered(spans)  # of one text
    ddl = "row bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept_text string"
    out = arrow_schema(ddl)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text, covered in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("covered").to_pylist()):
                data = text.as_py()
                gone = merged([(c["lo"], c["hi"]) for c in covered])
                if texts:
                    gone = whole_letters(data, gone)
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                found.append((
                    row, len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone],
                    kept.decode("utf-8", "replace") if texts else None,
                ))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    removed = touched.dropDuplicates(["row"]).join(by_row, F.col("row") == F.col("r")).select("row", "text", "covered").mapInArrow(remove, ddl)
    removed = steps.write("removed", removed)
    steps.drop("met", "kinds", "touched", "hits")
    text = [F.coalesce("kept_text", F.col("text").cast("string")).alias("kept_text")] if texts else []
    whole = given.select(
        *held, "doc_id", "row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *([F.col("text")] if texts else [])
    )
    if report is not None:
        before.drop("long")
        whole = whole.join(repeated.withColumnRenamed("r", "row"), "row", "left")
    told = [F.coalesce("n_repeated", F.lit(0)).alias("n_repeated")] if report is not None else []
    return whole.join(removed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), *told, *text,
        *(F.col(new).alias(old) for new, old in held.items()),
    )
