"""Exact Jaccard join of shingle sets in their metric space: pivots, windows by the triangle inequality, and joins within regions.

The distance of two sets is 1 - |x & y| / |x | y|. Unrelated texts all lie at distance 1 from one another, so a text as a pivot tells
nothing about them. The pivots here are the sets of one shingle. A set lies at 1 - 1/|x| from the pivots of its own shingles and at 1
from all others: its Voronoi region is that of its own first pivot in one fixed order of all shingles. A set within distance r = 1 - t
of x misses at most |x| - ceil(t|x|) shingles of x, so x is replicated to as many regions more, its window, and any two sets within r
meet in the region of a pivot of both.

Regions are joined in two further metric spaces. Counts of shingles by hash bins are a contraction: their L1 distance is at most the
size of the symmetric difference. Within a region, sets whose counts are too far apart are parted; what stays connected over all
regions forms smaller regions, in which the sets themselves are joined: from one set as a pivot, all within r are linked and become
pivots in turn. Regions too large for a task are cut in blocks, and every pair of blocks is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim, texts_of
from sitelake.llm.components import components
from sitelake.llm.tables import ROW, Steps, runtime_filters

#: Pivots counted so often in one pass of a task, and so often over all, come last in the order, the rarer ones first; at most so many.
SEEN_HERE, SEEN_ALL, FREQUENT = 6, 24, 200_000
#: Rows of a region, and shingles of a small region, that one task takes at a time.
REGION_ROWS, REGION_SHINGLES = 4_096, 1_000_000
STEP, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, width: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words; of the whole text as one if it has fewer words; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(h) - width + 1
    out = h[:n].copy()
    for i in range(1, width):
        out *= STEP
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= FINISH
    out ^= out >> np.uint64(29)
    return np.unique(out)


def frequent_pivots(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of frequent shingles. They only set the order of the pivots; any order gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            kept = counts >= SEEN_HERE
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(counts[kept].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for text in texts_of(batch):
                held.append(shingles(text, width, words))
                size += len(held[-1])
                if size > 4_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN_ALL)
    found = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    hashes = found.column("s").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def window_size(n: int, num: int, den: int) -> int:
    """Regions of a set of n shingles: any set within r has one of so many first pivots."""
    return n - (num * n + den - 1) // den + 1


def bins(sets: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash, at most 255 each, in a number of bins that grows with the set.

    With b bins, two unrelated sets of n shingles differ by about 0.8 sqrt(2 n b); from n / 16 bins on that is more than links allow.
    """
    size = 64
    while size * 16 < len(sets):
        size *= 2
    return np.minimum(np.bincount((sets & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def set_rows(docs: DataFrame, width: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (size), a (hash of the set), pivots of the window and bins, for each row; and its number, if rows have one."""
    numbers = [ROW] if ROW in docs.columns else []
    ddl = ", ".join(["doc_id bigint, n bigint, a bigint, pivots array<bigint>, bins binary", *(f"{c} bigint" for c in numbers)])
    out = arrow_schema(ddl)
    hashes, counts = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            n, a, pivots, sketches = [], [], [], []
            for text in texts_of(batch):
                s = shingles(text, width, words)
                n.append(len(s))
                a.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                order = s
                if len(hashes) and len(s):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    often = hashes[at] == s
                    late = s[often]
                    order = np.concatenate([s[~often], late[np.lexsort((late, counts[at[often]]))]])
                pivots.append(order[: window_size(len(s), num, den)].view(np.int64) if len(s) else np.empty(0, np.int64))
                sketches.append(bins(s))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pivots])]).astype(np.int32)
            values = pa.array(np.concatenate(pivots))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), values).cast(out.field("pivots").type), pa.array(sketches, pa.binary()),
                    *(batch.column(c) for c in numbers),
                ],
                schema=out,
            )

    return docs.mapInArrow(run, ddl)


def in_blocks(df: DataFrame, total: F.Column, most: int) -> DataFrame:
    """`part`: 0 for groups up to `most`; larger ones are cut in blocks by `a`, and a row goes to every pair with its block."""
    blocks = F.when(total > most, F.ceil(2 * total / most)).otherwise(1).cast("bigint")
    own = F.pmod(F.xxhash64("a"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least(F.col("own"), j) * F.col("blocks") + F.greatest(F.col("own"), j))
    return df.withColumn("blocks", blocks).withColumn("own", own).withColumn("part", F.explode(pairs)).drop("blocks", "own")


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of equal keys, from batches sorted by them."""
    held: list[tuple] = []
    last: tuple | None = None
    for batch in batches:
        ks = zip(*(batch.column(k).to_pylist() for k in keys))
        rows = zip(*(batch.column(c).to_pylist() for c in columns))
        for key, row in zip(ks, rows):
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def may_link(nx: int, ny: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the L1 distance of the counts leaves room for the needed overlap."""
    room = nx + ny - 2 * (-(-num * (nx + ny) // (num + den)))
    if abs(nx - ny) > room:
        return False
    size = min(len(x), len(y))
    if len(x) != len(y):
        x, y = (np.minimum(v.reshape(-1, size).astype(np.int32).sum(0), 255) for v in (x, y))
    return int(np.abs(x.astype(np.int32) - y).sum()) <= room


def region_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect, within every region, the sets whose counts may be near; as few as connect them."""

    def connect(group: list[tuple]) -> list[tuple[int, int]]:
        if len(group) == 2:
            (a, nx, x), (b, ny, y) = group
            return [(a, b)] if a != b and may_link(nx, ny, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), num, den) else []
        n = np.array([g[1] for g in group], np.int64)
        size = 64
        folded = np.stack([np.minimum(np.frombuffer(g[2], np.uint8).reshape(-1, size).astype(np.int16).sum(0), 255) for g in group])
        left, found = np.arange(len(group)), []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                total = n[x] + n[left]
                room = total - 2 * (-(-num * total // (num + den)))
                near = np.abs(folded[left] - folded[x]).sum(1) <= room
                for y in left[near]:
                    if len(group[x][2]) == size or may_link(
                        int(n[x]), int(n[y]), np.frombuffer(group[x][2], np.uint8), np.frombuffer(group[y][2], np.uint8), num, den
                    ):
                        found.append((group[x][0], group[y][0]))
                        queue.append(int(y))
                    else:
                        near[np.searchsorted(left, y)] = False
                left = left[~near]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for group in groups_of(batches, ("s", "part"), ("a", "n", "bins")):
            edges.update(connect(group))
            if len(edges) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])
                edges.clear()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])

    return rows.repartition("s", "part").sortWithinPartitions("s", "part").mapInArrow(run, "a bigint, b bigint")


def linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect exactly the sets linked within a list, by index; every set reached is a pivot once."""
    if len(sets) == 2:
        x, y = sets
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [(0, 1)] if both * (num + den) >= num * (len(x) + len(y)) else []
    sizes = np.array([len(s) for s in sets], np.int64)
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    holders = owner[np.argsort(inverse, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
    ends = np.cumsum(sizes)
    waiting = np.ones(len(sets), bool)
    edges = []
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            own = inverse[ends[x] - sizes[x] : ends[x]]
            lengths = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            near = waiting & (shared * (num + den) >= num * (sizes + sizes[x]))
            for y in np.flatnonzero(near):
                edges.append((x, int(y)))
                queue.append(int(y))
            waiting &= ~near
    return edges


def exact_edges(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) of the links within every small region, from the texts: component, part, a, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for group in groups_of(batches, ("component", "part"), ("a", "text")):
            found = {}
            for a, text in group:
                s = shingles(text or "", width, words)
                if np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) == a:
                    found[a] = s
            if len(found) > 1:
                names = list(found)
                edges = [(names[x], names[y]) for x, y in linked(list(found.values()), num, den)]
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])

    return rows.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, row_col: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest doc_id reachable over links of similarity num/den or more.

    Texts are sets of shingles of `width` words (lower case A-Z, words between ASCII white space). Rows with equal sets are one node
    throughout, so copies are never paired. Texts without words (null, empty, blank) have no shingle and stay alone. A row without id
    takes part in no link and has no component. Rows with the same id and text share one component; rows with the same id and
    different texts are told apart by their texts. Other columns are left out; an empty table gives an empty result. Sets are told
    apart by 64-bit hashes. With `row_col`, the number of each row, there are also that number, `a` (hash of the row's set) and
    `component`, which tells components apart that share their smallest id; null for rows that take part in no link.
    """
    steps = Steps(docs.sparkSession, "jaccard")
    rows = slim(docs, doc_id=id_col, text=text_col, **{ROW: row_col})
    sets = steps.write("sets", set_rows(rows, width, num, den, frequent_pivots(rows, width)))
    members = steps.write("members", sets.drop("pivots", "bins"))
    with_id = sets.where("doc_id is not null and n > 0")
    nodes = steps.write("nodes", with_id.groupBy("a").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("pivots").alias("pivots"), F.first("bins").alias("bins")))
    steps.drop("sets")
    spread = nodes.select(F.explode("pivots").alias("s"), "a")
    regions = spread.groupBy("s").agg(F.count("*").alias("rows")).where("rows > 1")
    met = steps.write("met", spread.join(regions, "s"))
    rows_met = in_blocks(met, F.col("rows"), REGION_ROWS).drop("rows").join(nodes.select("a", "n", "bins"), "a")
    near = components(region_edges(rows_met, num, den), steps, "near")
    sized = near.join(nodes.select(F.col("a").alias("node"), "rep", "n"), "node")
    totals = sized.groupBy("component").agg(F.sum("n").alias("total"))
    wanted = steps.write("wanted", in_blocks(sized.withColumnRenamed("node", "a").join(totals, "component"), F.col("total"), REGION_SHINGLES).select("component", "part", "a", "rep"))
    # Most texts are near no other: the condition, which all rows meet, lets Spark filter texts by the wanted ids before it shuffles them.
    texts = wanted.where("part >= 0").join(rows, wanted.rep == rows.doc_id).select("component", "part", "a", "text")
    with runtime_filters(docs.sparkSession):
        links = components(exact_edges(texts, width, num, den), steps, "links")
    named = nodes.select("a", "rep").join(links.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = steps.write("labels", named.join(smallest, "component").select("a", "component", "component_id"))
    steps.drop("nodes", "met", "wanted")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    group = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component"))
    numbers = [F.col(ROW).alias(row_col), F.col("a"), group.alias("component")] if row_col else []
    return members.join(labels, "a", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *numbers)
