"""Quality rules from compression: zstandard ratios of whole texts and of fixed chunks against limits by length.

Limits are learnt from the corpus, without labels. Short texts compress badly for lack of context and long ones well, so texts are
compared with those of about their length: half octaves of bytes. Within such a band the ratios of prose lie close together. Their
middle half, counted over all texts that pass the base rules, gives a middle and a spread on each side; a text that compresses much
better than its band is repetitive, one that compresses much worse is incompressible. Chunks have one size and one such band.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim, texts_of
from sitelake.llm.tables import Steps

SYMBOLS = "#*$%&|<>"
CHUNK_BYTES = 512
#: Share of chunks outside their limits beyond which a text is rejected.
CHUNK_SHARE = 1 / 3
LEVEL = 3
#: Spreads from the middle at which the limits lie: above and below for whole texts, above and below for chunks.
REACH = (3.0, 4.5, 2.5, 3.75)
#: Half of a normal distribution lies within so many of its spreads.
QUARTILE = 0.6745
#: A band with fewer texts than these has no middle half worth the name; it keeps the wide limits that hold for any prose.
FEWEST = 20
WIDE = (0.7, 4.2)


@dataclass(frozen=True)
class Bands:
    """Limits (least, greatest ratio) by half octave of bytes, and of chunks; WIDE where there is none."""

    whole: dict[int, tuple[float, float]] = field(default_factory=dict)
    chunk: tuple[float, float] = WIDE


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window found at least twice in the text, the first find included."""
    if len(words) <= window:
        return 0
    windows = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + window - max(end, i)
            end = i + window
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "n_bytes bigint, ratio double, chunk_ratios array<double>"
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """One row per input row: word statistics, the base rules, and compression ratios (bytes over compressed bytes) of the whole text
    and of its whole chunks. No shuffle. Null and empty texts have no words, ratio 0 and fail the base rules."""
    out = arrow_schema(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                n, repeated = len(words), repeated_words(words)
                spaces = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
                chunks = [chunk_bytes / len(packer.compress(data[i : i + chunk_bytes])) for i in range(0, len(data) - chunk_bytes + 1, chunk_bytes)]
                rows.append((
                    doc_id, n, len(text) - spaces, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeated, n < 10 or 100 * repeated > 20 * n,
                    len(data), len(data) / len(packer.compress(data)) if data else 0.0, chunks,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, MEASURES)


def half_octave(n_bytes: Column) -> Column:
    return F.floor(2 * F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))).cast("int")


def learnt_bands(measured: DataFrame, reach: tuple[float, float, float, float] = REACH, fewest: int = FEWEST) -> Bands:
    """Limits from the ratios of all texts that pass the base rules.

    Ratios are counted in hundredths (10 and above together), so what is counted, shuffled and collected does not grow with the texts.
    """
    fit = measured.where("not base_failed")
    rounded = lambda c: F.least(F.floor(F.col(c) * 100), F.lit(1_000)).cast("int")
    whole = fit.select(half_octave(F.col("n_bytes")).alias("band"), rounded("ratio").alias("r"))
    chunk = fit.select(F.lit(-1).alias("band"), F.explode("chunk_ratios").alias("ratio")).select("band", rounded("ratio").alias("r"))
    counts = whole.unionByName(chunk).groupBy("band", "r").agg(F.count("*").alias("n"))
    quarters = counts.groupBy("band").agg(F.sum("n").alias("n"), F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    limits = {}
    for row in quarters.where(F.col("n") >= fewest).collect():  # a row for each half octave
        low, middle, high = ((float(q) + 0.5) / 100 for q in row.q)
        up, down = (reach[2], reach[3]) if row.band < 0 else (reach[0], reach[1])
        spread = lambda side: max(side, 0.01) / QUARTILE
        limits[row.band] = (middle - down * spread(middle - low), middle + up * spread(high - middle))
    return Bands({k: v for k, v in limits.items() if k >= 0}, limits.get(-1, WIDE))


def judged(measured: DataFrame, bands: Bands, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """The measures with `band` (half octave), n_chunks, n_bad_chunks, `verdict` (base, repetitive, incompressible, chunks or kept) and kept."""
    band = half_octave(F.col("n_bytes"))
    limit = lambda i: F.coalesce(
        F.try_element_at(F.create_map(*(F.lit(x) for k, v in bands.whole.items() for x in (k, float(v[i])))), band) if bands.whole else F.lit(None), F.lit(WIDE[i])
    )
    low, high = (float(x) for x in bands.chunk)
    bad = F.size(F.filter("chunk_ratios", lambda r: (r < low) | (r > high)))
    verdict = (
        F.when(F.col("base_failed"), "base").when(F.col("ratio") > limit(1), "repetitive").when(F.col("ratio") < limit(0), "incompressible")
        .when(bad > chunk_share * F.size("chunk_ratios"), "chunks").otherwise("kept")
    )
    return measured.select(
        *(c for c in measured.columns if c != "chunk_ratios"), band.alias("band"), F.size("chunk_ratios").cast("bigint").alias("n_chunks"),
        bad.cast("bigint").alias("n_bad_chunks"), verdict.alias("verdict"), (verdict == "kept").alias("kept"),
    )


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None, chunk_bytes: int = CHUNK_BYTES,
    chunk_share: float = CHUNK_SHARE, level: int = LEVEL, reach: tuple[float, float, float, float] = REACH,
) -> DataFrame:
    """One row per input row: measures and verdict; limits are those of the corpus unless `bands` are given.

    A text is rejected if the base rules fail, if its own ratio is outside the limits of its length, or if more than `chunk_share` of
    its whole chunks are outside theirs. Texts are read once. Null and empty texts fail the base rules. Equal rows give equal rows;
    null ids stay null; other columns are left out; an empty table gives an empty result.
    """
    measured = measures(docs, id_col, text_col, chunk_bytes, level)
    if bands is None:
        measured = Steps(docs.sparkSession, "quality").write("measures", measured)
        bands = learnt_bands(measured, reach)
    return judged(measured, bands, chunk_share)


def band_report(found: DataFrame) -> DataFrame:
    """Texts by half octave of bytes and verdict."""
    return found.groupBy("band", "verdict").agg(F.count("*").alias("n"))
