"""I-Match fingerprints: terms of a band of inverse document frequency, sorted and hashed through randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim, texts_of

#: Terms in more than the first share of the documents say little, terms in fewer than the second are likely slips.
BAND = (0.05, 1e-4)
#: Bytes of text in a range of ids.
RANGE_BYTES = 64_000_000
#: Random subsets for each of two levels, and how many of a text's terms the finer one keeps on average.
SUBSETS, KEPT = 32, 2.0

BLANKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))
SALTS = np.array([xxhash.xxh3_64_intdigest(b"subset", seed=r) for r in range(SUBSETS)], dtype=np.uint64)


def terms_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z), cut at ASCII characters other than letters and digits."""
    return text.encode("utf-8", "surrogatepass").lower().translate(BLANKS).split()


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (hash) and n, the number of documents with the term, over all documents."""
    out = arrow_schema("term bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            done = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], schema=out)
            counts.clear()
            return done

        for batch in batches:
            for text in texts_of(batch):
                counts.update(set(terms_of(text)))
                if len(counts) > 1_000_000:
                    yield flush()
        if counts:
            yield flush()

    return slim(docs, text=text_col).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def band_lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of all terms within the band.

    A term of the band is in at least `band[1]` of the documents, so there are at most 1 / band[1] times as many as the average
    document has distinct terms (10,000 times at the default, whatever the number of documents): some tens of MB at most, which the
    driver and every worker hold.
    """
    total = docs.count()
    inside = document_frequencies(docs, text_col).where((F.col("n") <= band[0] * total) & (F.col("n") >= max(2.0, band[1] * total)))
    return np.sort(inside.select("term").toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


class _Known(dict):
    """Term -> its hash if the lexicon has it, else 0; of the last used terms."""

    def __init__(self, lexicon: np.ndarray):
        super().__init__()
        self.lexicon = lexicon

    def learn(self, terms: list[bytes]) -> bool:
        """Look up many terms at once; whether others were let go for them."""
        if full := len(self) > 600_000:
            self.clear()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
        if not len(self.lexicon):
            self.update(dict.fromkeys(terms, 0))
            return full
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        there = self.lexicon[at] == hashes
        self.update(zip(terms, (h if has else 0 for h, has in zip(hashes.tolist(), there.tolist()))))
        return full


STEP, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * STEP
    h ^= h >> np.uint64(29)
    h *= FINISH
    return h ^ (h >> np.uint64(32))


def subset_hashes(terms: np.ndarray, kept: np.ndarray) -> list[str]:
    """Six digits of the hash of each subset (row of `kept`) of the sorted terms: places and terms mixed and added up; `-` if empty."""
    subset, at = np.nonzero(kept)
    sizes = np.bincount(subset, minlength=len(kept))
    begins = np.cumsum(sizes) - sizes
    place = (np.arange(len(at)) - begins[subset]).astype(np.uint64)
    parts = mixed(terms[at] + place * STEP)
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    sums = mixed(ends[begins + sizes] - ends[begins]) >> np.uint64(40)
    return [f"{v:06x}" if n else "-" for v, n in zip(sums.tolist(), sizes.tolist())]


def fingerprint(text: str, known: _Known) -> tuple[int, list[str], list[str]]:
    """Level, and the hashes of the text's sorted terms in every subset at that level and the next.

    At level l a subset keeps each term of the lexicon with probability 2^-l. The level follows the number of terms, so that a subset
    holds about `KEPT` terms of any text, long or short. An empty subset has the hash `-`. A text without any term of the lexicon is
    told by all its terms.
    """
    found = set(terms_of(text))
    hashes = list(map(known.get, found, repeat(-1)))
    if -1 in hashes:
        if known.learn([t for t, h in zip(found, hashes) if h == -1]):
            known.learn([t for t in found if t not in known])
        hashes = list(map(known.get, found))
    inside = list(filter(None, hashes)) or list(map(xxhash.xxh3_64_intdigest, found))
    terms = np.sort(np.array(inside, dtype=np.uint64))
    level = max(0, round(math.log2(max(1, len(terms)) / KEPT)))
    draws = mixed(terms[None, :] ^ SALTS[:, None])
    out = [subset_hashes(terms, (draws & np.uint64((1 << bits) - 1)) == 0) for bits in (level, level + 1)]
    return level, out[0], out[1]


def likeness(a: tuple[int, list[str], list[str]], b: tuple[int, list[str], list[str]]) -> float:
    """Share of subsets with equal hashes among those that are not empty for both, at the level both have; the larger of two.

    1 for equal fingerprints, 0 if the texts' sizes differ so much that no level is shared.
    """
    if a == b:
        return 1.0
    best = 0.0
    for i, j in ((1, 1 + a[0] - b[0]), (2, 2 + a[0] - b[0])):
        if 1 <= j <= 2:
            pairs = [(x, y) for x, y in zip(a[i], b[j]) if x != "-" or y != "-"]
            if pairs:
                best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def as_text(f: tuple[int, list[str], list[str]]) -> str:
    return f"{f[0]}:{'.'.join(f[1])}:{'.'.join(f[2])}"


def fingerprints(docs: DataFrame, lexicon: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row. Null and empty texts have the fingerprint of no terms. No shuffle."""
    out = arrow_schema("doc_id bigint, fingerprint string")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            prints = [as_text(fingerprint(t, known)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], schema=out)

    return slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, fingerprint string")


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id bigint"
)


def edited_fingerprints(docs: DataFrame, lexicon: np.ndarray, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last `1/part` gives way to the beginning of the next document.

    The next document is the next by ascending id, null last, and after the last the first; rows of one id come in a fixed order.
    Null texts count as empty. Texts travel once, packed, to ranges of ids; the first document of each range is also sent to the end
    of the range before, so that every document meets its successor. A task reads its range in order and holds two documents.
    A table of one row edits it with itself; an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    rows = slim(docs, doc_id=id_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    cuts = rows.where("doc_id is not null").approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.float64).astype(np.int64))

    def ranges(ids: pa.Array) -> np.ndarray:
        null = np.array(ids.is_null())
        found = np.searchsorted(bounds, np.array(ids.fill_null(0), dtype=np.int64), side="right")
        return np.where(null, len(bounds), found)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(ranges(ids), pa.int64()), ids], names=["range", "doc_id"])

    # A row for each range. A range of null ids alone begins with a null.
    heads = {
        r["range"]: r.head
        for r in rows.select("doc_id").mapInArrow(firsts, "range bigint, doc_id bigint").groupBy("range").agg(F.min("doc_id").alias("head")).collect()
    }
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    packed = "range bigint, follows int, doc_id bigint, packed binary"
    packed_schema = arrow_schema(packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            found = []
            for r, doc_id, text in zip(ranges(ids).tolist(), ids.to_pylist(), texts_of(batch)):
                data = packer.compress(text.encode("utf-8", "surrogatepass"))
                found.append((r, 0, doc_id, data))
                if doc_id == heads[r]:
                    found.append((before[r], 1, doc_id, data))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), packed_schema)], schema=packed_schema)

    out = arrow_schema(EDITED)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpacker = _Known(shared.value), zstandard.ZstdDecompressor()
        held = None  # range, id, text, fingerprint of the document whose successor comes next
        done: list[tuple] = []

        def finish(text: str, print_: tuple, next_id: int | None) -> None:
            _, doc_id, own, own_print = held
            n = len(own)
            cut = n // part
            edited = own[: n - cut] + text[:cut]
            edited_print = fingerprint(edited, known) if edited != own else own_print
            done.append((
                doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_print), as_text(edited_print),
                likeness(own_print, edited_print), likeness(own_print, print_), next_id,
            ))

        for batch in batches:
            for r, follows, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("range", "follows", "doc_id", "packed"))):
                if follows and (held is None or held[0] != r):
                    continue
                text = unpacker.decompress(data).decode("utf-8", "surrogatepass")
                print_ = fingerprint(text, known)
                if held is not None and held[0] == r:
                    finish(text, print_, doc_id)
                held = None if follows else (r, doc_id, text, print_)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                done.clear()

    spread = rows.mapInArrow(pack, packed).repartition(n_ranges, "range")
    return spread.sortWithinPartitions("range", "follows", F.col("doc_id").asc_nulls_last(), "packed").mapInArrow(run, EDITED)
