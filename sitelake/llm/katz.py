"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights, kept in tables.

The corpus is cut in blocks of texts. Words get numbers and training counts from ranges of word hashes. Then, order by order from the
pairs on, every block sends the distinct n-grams of its training texts by history (the words it was followed by, their counts, and the
counts of their shorter n-grams) to buckets of histories, packed by block and bucket. A bucket adds the counts up to a table of n-grams by
history with what the history's backoff weight is made from. The distinct n-grams of all texts of a block meet that table in the same
buckets and come back with their counts and weights. Each order stands on the counts that came back for the order below, and a token's
probability is worked out in the same recursion: n-gram, else backoff weight times the next lower order, down to words and the mass of
unknown words.

Histories with a large part of all tokens are dealt to buckets by their next word; their sums are put together by a groupBy.

P(w|h) = d c(h,w) / c(h) for n-grams seen in training, else a(h) P(w|h') with h' the history without its first word; P(w) = d c(w) / N
for known words, else the left mass of P. a(h) is the mass that discounts leave at h over the mass of P(.|h') outside the words seen
after h. A history without left mass (no count of 5 or less) is read as if seen once more, with an unseen word. After an unseen history
P(w|h') holds alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, remainder_is, slim
from sitelake.llm.jaccard import WordHashes, groups_of
from sitelake.llm.tables import Steps

#: Text bytes of a block, and of the corpus for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 6_000_000, 20_000_000
#: Buckets for each range of word hashes.
RANGE_BUCKETS = 8
#: Counts up to this one are discounted.
LAST = 5
#: A history with more than one in so many tokens for each bucket is dealt to so many buckets.
FREQUENT, SPREAD = 4, 64
#: Hash of the mark after a text; no word has white space. The mark before a text has the number 0.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Words are numbered from 1 to this.
MOST_WORDS = (1 << 31) - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, whole numbers in the smallest kind that holds them, their bytes apart by place, compressed."""
    parts, head = [], []
    for a in arrays:
        if len(a):
            a = a.astype(np.min_scalar_type(int(a.max())))
        head.append(f"{a.dtype.str}:{len(a)}")
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join([",".join(head).encode(), b"".join(parts)]))


def unpack(data: bytes) -> list[np.ndarray]:
    """Arrays as packed, in small kinds, which keeps what a task holds small."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    end = raw.index(b"\n")
    out, at = [], end + 1
    for part in raw[:end].decode().split(","):
        kind, n = part.split(":")
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, int(n) * size, at).reshape(size, int(n))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += planes.size
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Factors d_1 .. d_5 from the numbers n_1 .. n_6 of events seen so often.

    Katz's formula where it gives factors between 0 and 1; else, as with few or repeated texts, a constant is taken off each count.
    """
    if all(n) and (a := (LAST + 1) * n[LAST] / n[0]) < 1:
        d = np.array([((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, LAST + 1)])
        if (d > 0).all() and (d < 1).all():
            return d
    off = min(max(n[0] / (n[0] + 2 * n[1]), 0.05), 0.95) if n[0] else 0.5
    return np.array([(r - off) / r for r in range(1, LAST + 1)])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts times their discount."""
    return np.concatenate([[0.0], d, [1.0]])[np.minimum(counts, LAST + 1)] * counts


class Words:
    """P(w) by training count, exactly normalised over the known words and one unknown."""

    def __init__(self, tokens: int, n: list[int]):
        self.tokens, self.d = tokens, discounts(n)
        left = sum(n[r - 1] * r * (1 - self.d[r - 1]) for r in range(1, LAST + 1))
        #: Without a discounted count the unknown word is read as seen once.
        self.total, self.unknown = (tokens, left / tokens) if left > 0 else (tokens + 1, 1 / (tokens + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.int64)
        return np.where(c == 0, self.unknown, discounted(c, self.d) / max(self.total, 1))


def spread_out(h: np.ndarray, n: int) -> np.ndarray:
    """Range of a hash, 0 to n - 1; sorted hashes have sorted ranges."""
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def steps_of(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising words of rows of n words each, as differences within a row."""
    out = np.diff(w, prepend=0)
    starts = np.cumsum(n) - n
    out[starts] = w[starts]
    return out


def from_steps(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    starts = np.cumsum(n) - n
    return total - np.repeat(total[starts] - steps[starts].astype(np.int64), n)


def log_weight(ch: np.ndarray, covered: np.ndarray, few: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and log10 of the backoff weight of histories: counts, mass of P(.|h') behind their seen words, words seen once to five times."""
    left = few[:, :LAST] @ (np.arange(1, LAST + 1) * (1 - d))
    mass = np.where(left > 0, left / np.maximum(ch, 1), 1 / (ch + 1))
    return ch + (left == 0), np.log10(mass) - np.log10(np.maximum(1 - covered, 1e-300))


DOCS = "block bigint, data binary, row bigint, train boolean"
BLOCKS = "block bigint, vocab binary, data binary"


def packed_texts(rows: DataFrame) -> DataFrame:
    """Rows of block, row, train and text, with the text packed, as rows of DOCS."""
    out = arrow_schema(DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([packer.compress(t.as_buffer()) if t.is_valid else packer.compress(b"") for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), data, batch.column("row"), batch.column("train")], schema=out)

    return rows.mapInArrow(run, DOCS)


def hashed_blocks(docs: DataFrame) -> DataFrame:
    """One row for each block: its distinct words with their training counts, and its rows with their tokens as places in them."""
    out = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, words = zstandard.ZstdDecompressor(), WordHashes()
        for group in groups_of(batches, ("block",), ("block", "data", "row", "train")):
            if len(words) > 100_000:
                words.clear()
            found = []
            for g in group:
                ws = unpacker.decompress(g[1]).lower().split()
                found.append(np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws)))
                found.append(np.array([END]))
            lengths = np.array([len(found[i]) + 1 for i in range(0, len(found), 2)], np.int64)
            train = np.array([g[3] for g in group], bool)
            vocab, word = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(word, np.repeat(train, lengths), len(vocab)).astype(np.int64)
            held = np.array([g[2] for g in group], np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0][0]]), pa.array([pack(vocab, counts)], pa.binary()), pa.array([pack(held, train.astype(np.uint8), lengths, word)], pa.binary())],
                schema=out,
            )

    return docs.mapInArrow(run, BLOCKS)


def word_totals(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """kind, block, range, data: totals and numbers of each block's words by range (b), and statistics (s).

    Words of a range are numbered by falling count, and the numbers of all ranges interleave, so that frequent words have small ones.
    """
    ddl = "block bigint, range bigint, data binary"
    out = arrow_schema(ddl)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("vocab").to_pylist()):
                vocab, counts = unpack(data)
                ranges = spread_out(vocab.astype(np.uint64), n_ranges).astype(np.int64)
                cuts = np.searchsorted(ranges, np.arange(n_ranges + 1))
                rows = [(block, r, pack(vocab[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]])) for r in range(n_ranges) if cuts[r] < cuts[r + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    back_ddl = "kind string, block bigint, range bigint, data binary"
    back = arrow_schema(back_ddl)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ("range",), ("range", "block", "data")):
            parts = [(g[1], *unpack(g[2])) for g in group]
            vocab, which = np.unique(np.concatenate([p[1].astype(np.uint64) for p in parts]), return_inverse=True)
            total = np.bincount(which, np.concatenate([p[2] for p in parts]), len(vocab)).astype(np.int64)
            r, at, rows = group[0][0], 0, []
            number = np.empty(len(vocab), np.int64)
            number[np.argsort(-total, kind="stable")] = 1 + r + n_ranges * np.arange(len(vocab))
            if number.max() > MOST_WORDS:
                raise ValueError("too many distinct words")
            for block, words, _ in parts:
                here = which[at : at + len(words)]
                rows.append(("b", block, r, pack(total[here], number[here])))
                at += len(words)
            few = np.bincount(np.minimum(total, LAST + 2), minlength=LAST + 3)[1 : LAST + 2]
            rows.append(("s", None, r, np.array([total.sum(), (total > 0).sum(), *few], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), back)], schema=back)

    return blocks.mapInArrow(send, ddl).repartition("range").sortWithinPartitions("range", "block").mapInArrow(add, back_ddl)


def numbered_blocks(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """block, data: a block's rows with their tokens as places in its distinct words, which have numbers and training counts."""
    ddl = "block bigint, data binary"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ("block",), ("block", "range", "data")):
            held, train, lengths, word = unpack(next(g[2] for g in group if g[1] < 0))
            parts = [unpack(g[2]) for g in group if g[1] >= 0]
            total, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(number)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0][0]]), pa.array([pack(held, train, lengths, number[order], total[order], place[word])], pa.binary())], schema=out
            )

    both = blocks.select("block", F.lit(-1).cast("bigint").alias("range"), "data").union(totals.where("kind = 'b'").select("block", "range", "data"))
    return both.repartition("block").sortWithinPartitions("block", "range").mapInArrow(run, ddl)


class Level:
    """What is known of each token of a block at one order: count of its n-gram, scale and key of its history, log10 of its probability."""

    def __init__(self, count: np.ndarray, scale: np.ndarray, key: np.ndarray, logp: np.ndarray):
        self.count, self.scale, self.key, self.logp = count, scale, key, logp


class Block:
    """The tokens of a block: their documents, places, word numbers and counts."""

    def __init__(self, data: bytes, words: Words, train_docs: int):
        self.rows, train, lengths, number, total, word = unpack(data)
        self.lengths = lengths.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(len(word)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.train = train.astype(bool)[self.doc]
        self.w = number.astype(np.int64)[word]
        self.c1 = total.astype(np.int64)[word]
        self.train_docs = train_docs
        self.words = Level(self.c1, np.full(len(word), words.total), np.zeros(len(word), np.uint64), np.log10(words.p(self.c1)))

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's value of the token before it; `first` for the first of a text."""
        out = np.roll(values, 1)
        out[self.place == 0] = first
        return out


class Grams:
    """Distinct n-grams of an order in a block, by bucket, key of their history and word; those of training texts only, if asked."""

    def __init__(self, block: Block, below: Level, order: int, deal: Deal, train: bool):
        mixed = (below.key * np.uint64(0xBF58476D1CE4E5B9) + block.w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        #: Key of each token's history; that of the mark before a text is 0.
        self.key = block.before(mixed ^ (mixed >> np.uint64(31)), 0)
        # A history is the shorter n-gram that ends with the token before, so its count is known.
        self.seen = block.before(below.count, block.train_docs)
        valid = block.place >= order - 2
        self.tokens = np.flatnonzero(valid & block.train if train else valid)
        w = block.w[self.tokens]
        keys, history = np.unique(self.key[self.tokens], return_inverse=True)
        part = np.where(self.seen[self.tokens] > deal.frequent, w % deal.spread, 0)
        grams, first, gram = np.unique((history * deal.spread + part) << 32 | w, return_index=True, return_inverse=True)
        # A row has the words after one history, or those of one of its parts.
        row = grams >> 32
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        n, row = np.diff(np.append(starts, len(row))), row[starts]
        bucket = deal.bucket(keys[row // deal.spread], row % deal.spread)
        rows = np.argsort(bucket, kind="stable")
        self.n, self.h, self.bucket = n[rows], keys[row[rows] // deal.spread], bucket[rows]
        #: Ends of rows; place of each n-gram before rows were put in order of their buckets.
        self.ends = np.cumsum(self.n)
        moved = np.repeat(starts[rows] - (self.ends - self.n), self.n) + np.arange(len(grams))
        self.w, self.first = grams[moved] & 0xFFFFFFFF, first[moved]
        at = np.empty(len(grams), np.int64)
        at[moved] = np.arange(len(grams))
        self.gram = at[gram]

    def packs(self, *by_gram: np.ndarray, by_row: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[int, bytes]]:
        """Bucket and pack of histories, words in each, what is given by row, words, and what is given by n-gram."""
        cuts = [*np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.bucket)]
        steps = steps_of(self.w, self.n)
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = self.ends[lo] - self.n[lo], self.ends[hi - 1]
            yield int(self.bucket[lo]), pack(self.h[lo:hi], self.n[lo:hi], *(x[lo:hi] for x in by_row), steps[a:b], *(x[a:b] for x in by_gram))


class Deal:
    """How histories are dealt to buckets: those with more tokens than `frequent` by their next word."""

    def __init__(self, n_buckets: int, tokens: int):
        self.n_buckets, self.spread, self.frequent = n_buckets, min(SPREAD, n_buckets), tokens / (FREQUENT * n_buckets)

    def bucket(self, h: np.ndarray, part: np.ndarray) -> np.ndarray:
        away = part * max(1, self.n_buckets // SPREAD)
        return (((h >> np.uint64(24)) % np.uint64(self.n_buckets)).astype(np.int64) + away) % self.n_buckets


COUNTED = "bucket bigint, data binary"
#: For each bucket its packed n-grams and how many were counted once to six times; and the sums of histories that are dealt.
TABLE = "bucket bigint, h bigint, ch bigint, covered double, few array<bigint>, data binary"
MET = "bucket bigint, block bigint, h bigint, scale bigint, weight double, data binary"
RESULT = "block bigint, `order` int, bucket bigint, data binary"


class Model:
    """The n-gram tables of one corpus, made order by order, and what came back from them to the blocks."""

    def __init__(self, steps: Steps, blocks: DataFrame, words: Words, train_docs: int, n_buckets: int):
        self.steps, self.blocks, self.words, self.train_docs = steps, blocks, words, train_docs
        self.deal = Deal(n_buckets, words.tokens)
        #: Discounts of each order, from words on.
        self.d = [words.d]
        self.results: list[DataFrame] = []

    def each_block(self, function, ddl: str) -> DataFrame:
        """function(block number, block, levels from words to the highest order done) gives Arrow batches for each block."""
        words, train_docs, deal, d = self.words, self.train_docs, self.deal, list(self.d)

        def levels_of(block: Block, packs: list[tuple[int, bytes]]) -> list[Level]:
            levels = [block.words]
            for order in range(2, len(d) + 1):
                below = levels[-1]
                g = Grams(block, below, order, deal, False)
                level = Level(np.zeros(len(block.w), np.int64), np.zeros(len(block.w), np.int64), g.key, below.logp.copy())
                parts = [unpack(data) for o, data in packs if o == order]
                if parts:
                    scale, weight, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    scale, weight = np.repeat(scale.astype(np.int64), g.n), np.repeat(weight.astype(np.uint64).view(np.float64), g.n)
                    c = c.astype(np.int64)
                    with np.errstate(divide="ignore"):
                        seen = np.log10(discounted(c, d[order - 1]) / np.maximum(scale, 1))
                    t = g.tokens
                    level.count[t], level.scale[t] = c[g.gram], scale[g.gram]
                    level.logp[t] = np.where(c > 0, seen, weight)[g.gram] + np.where(level.count[t] > 0, 0.0, below.logp[t])
                levels.append(level)
            return levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, ("block",), ("block", "order", "data")):
                block = Block(group[0][2], words, train_docs)
                yield from function(group[0][0], block, levels_of(block, [g[1:] for g in group[1:]]))

        rows = self.blocks.select("block", F.lit(0).alias("order"), F.lit(0).cast("bigint").alias("bucket"), "data")
        if self.results:  # else a row is a whole block
            for r in self.results:
                rows = rows.union(r)
            rows = rows.repartition("block").sortWithinPartitions("block", "order", "bucket")
        return rows.mapInArrow(run, ddl)

    def count(self, order: int) -> DataFrame:
        """The table of n-grams of an order by history, each with the sums that its history's weight is made from."""
        deal, d = self.deal, self.d[-1]
        sent_schema, out = arrow_schema(COUNTED), arrow_schema(TABLE)

        def send(number: int, block: Block, levels: list[Level]) -> Iterator[pa.RecordBatch]:
            g = Grams(block, levels[-1], order, deal, True)
            if len(g.w):
                first = g.tokens[g.first]
                row = first[g.ends - g.n]
                packs = g.packs(np.bincount(g.gram, minlength=len(g.w)), levels[-1].count[first], by_row=(g.seen[row], levels[-1].scale[row]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*packs), sent_schema)], schema=sent_schema)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, ("bucket",), ("bucket", "data")):
                parts = []
                for _, data in group:
                    h, n, ch, scale, step, c, below = unpack(data)
                    n = n.astype(np.int64)
                    parts.append((h.astype(np.uint64), n, ch.astype(np.int64), scale.astype(np.int64), from_steps(step, n), c, below))
                h, n, ch, scale, w, c, below = (np.concatenate(p) for p in zip(*parts))
                del parts
                hist, at, of = np.unique(h, return_index=True, return_inverse=True)
                grams, first, which = np.unique(np.repeat(of, n) << 32 | w, return_index=True, return_inverse=True)
                total = np.bincount(which, c, len(grams)).astype(np.int64)
                del which, w, c
                owner, k = grams >> 32, len(hist)
                covered = np.bincount(owner, discounted(below[first].astype(np.int64), d) / scale[at][owner], k)
                few = np.stack([np.bincount(owner[total == r], minlength=k) for r in range(1, LAST + 2)], 1)
                ch = ch[at]
                n = np.bincount(owner, minlength=k)
                table = pack(hist, n, ch, covered.view(np.uint64), *few[:, :LAST].T, steps_of(grams & 0xFFFFFFFF, n), total)
                rows = [(group[0][0], None, None, None, few.sum(0).tolist(), table)]
                for i in np.flatnonzero(ch > deal.frequent):
                    rows.append((group[0][0], int(hist[i].astype(np.int64)), int(ch[i]), float(covered[i]), few[i].tolist(), None))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

        rows = self.each_block(send, COUNTED).repartition("bucket").sortWithinPartitions("bucket")
        return self.steps.write(f"grams{order}", rows.mapInArrow(add, TABLE))

    def meet(self, order: int, table: DataFrame, d: np.ndarray) -> DataFrame:
        """The counts of the distinct n-grams of all blocks, and the scales and weights of their histories, from the table."""
        deal = self.deal
        sent_schema, out = arrow_schema(MET), arrow_schema(RESULT)

        def send(number: int, block: Block, levels: list[Level]) -> Iterator[pa.RecordBatch]:
            rows = [(bucket, number, None, None, None, data) for bucket, data in Grams(block, levels[-1], order, deal, False).packs()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), sent_schema)], schema=sent_schema)

        def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                h, ch, covered, *few = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + LAST))
                scale, weight = log_weight(ch, covered, np.stack(few, 1), d)
                rows = []
                for i in range(len(h)):
                    buckets = np.unique(deal.bucket(h[i : i + 1].view(np.uint64), np.arange(deal.spread)))
                    rows += [(int(x), -2, int(h[i]), int(scale[i]), float(weight[i]), None) for x in buckets]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), sent_schema)], schema=sent_schema)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, ("bucket",), ("bucket", "block", "h", "scale", "weight", "data")):
                hist, known, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                scale, weight = np.zeros(0, np.int64), np.zeros(0)
                if tables := [g[5] for g in group if g[1] == -1]:
                    hist, n, ch, covered, *few, step, count = unpack(tables[0])
                    hist, n = hist.astype(np.uint64), n.astype(np.int64)
                    known = np.repeat(np.arange(len(hist)), n) << 32 | from_steps(step, n)
                    scale, weight = log_weight(ch.astype(np.int64), covered.astype(np.uint64).view(np.float64), np.stack(few, 1).astype(np.int64), d)
                if dealt := [g for g in group if g[1] == -2]:
                    keys = np.array([g[2] for g in dealt], np.int64).view(np.uint64)
                    new = np.setdiff1d(keys, hist)  # no n-gram of theirs was dealt here
                    order_of = np.argsort(np.concatenate([hist, new]), kind="stable")
                    place = np.empty(len(order_of), np.int64)
                    place[order_of] = np.arange(len(order_of))
                    hist, known = np.concatenate([hist, new])[order_of], place[known >> 32] << 32 | known & 0xFFFFFFFF
                    scale, weight = np.append(scale, np.zeros(len(new), np.int64))[order_of], np.append(weight, np.zeros(len(new)))[order_of]
                    at = np.searchsorted(hist, keys)
                    scale[at], weight[at] = [g[3] for g in dealt], [g[4] for g in dealt]
                # One place more, for what is not in the table.
                hist, known = np.append(hist, np.uint64((1 << 64) - 1)), np.append(known, np.int64((1 << 63) - 1))
                scale, weight, count = np.append(scale, 0), np.append(weight, 0.0), np.append(count, np.zeros(1, count.dtype))
                for _, block, _, _, _, data in group:
                    if block < 0:
                        continue
                    h, n, step = unpack(data)
                    h, n = h.astype(np.uint64), n.astype(np.int64)
                    of = np.searchsorted(hist, h)
                    of[hist[of] != h] = len(hist) - 1
                    asked = np.repeat(of, n) << 32 | from_steps(step, n)
                    at = np.searchsorted(known, asked)
                    c = np.where(known[at] == asked, count[at], 0)
                    open_ = np.bincount(np.repeat(np.arange(len(n)), n), c == 0, len(n)) > 0  # only their weights are needed
                    reply = pack(scale[of], np.where(open_, weight[of], 0.0).view(np.uint64), c)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, order, group[0][0], reply), out)], schema=out)

        none = [F.lit(None).cast(t).alias(n) for n, t in (("h", "bigint"), ("scale", "bigint"), ("weight", "double"))]
        grams = table.where("h is null").select("bucket", F.lit(-1).cast("bigint").alias("block"), *none, "data")
        # At most FREQUENT for each bucket.
        few = [F.sum(F.col("few")[i]).alias(f"f{i}") for i in range(LAST)]
        dealt = table.where("h is not null").groupBy("h").agg(F.max("ch").alias("ch"), F.sum("covered").alias("covered"), *few).mapInArrow(deal_out, MET)
        met = self.each_block(send, MET).union(grams).union(dealt).repartition("bucket").sortWithinPartitions("bucket", "block")
        return self.steps.write(f"met{order}", met.mapInArrow(look_up, RESULT))

    def add_order(self) -> None:
        """Count the n-grams one longer than those known, and let the blocks meet their table."""
        order = len(self.d) + 1
        table = self.count(order)
        few = table.where("h is null").agg(*(F.coalesce(F.sum(F.col("few")[i]), F.lit(0)).alias(f"n{i}") for i in range(LAST + 1))).first()
        d = discounts([int(x) for x in few])
        self.results.append(self.meet(order, table, d))
        self.d.append(d)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; the model learns from rows not held out.

    The model looks at `order` - 1 words before each. Held out are ids whose crc32 modulo 7 is 2; a null id is not. Words are runs
    without ASCII white space, A-Z in lower case; a text has one token more, its end, so a null or empty text has one token. base_score
    is the add-one unigram score. Rows with equal id and text are scored alike, once for each, and each counts. Other columns are left
    out; an empty table gives an empty result; without training rows every word has the probability of the unknown. Words and histories
    are told apart by 64-bit hashes. The tables of counts by history stay in the checkpoint folder with the other steps.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    steps = Steps(spark, "katz")
    slim_rows = slim(docs, doc_id=id_col, text=text_col)
    size = slim_rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~remainder_is("doc_id", 7, 2)).cast("bigint")).alias("train")).first()
    n_blocks, n_buckets = (max(1, math.ceil((size.bytes or 0) / b)) for b in (BLOCK_BYTES, BUCKET_BYTES))
    rows = slim_rows.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
        # A null id travels as the least number and comes back as null.
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row"), F.coalesce(~remainder_is("doc_id", 7, 2), F.lit(True)).alias("train"), "text",
    )
    hashed = steps.write("hashed", hashed_blocks(packed_texts(rows).repartition("block").sortWithinPartitions("block")))
    totals = steps.write("words", word_totals(hashed, math.ceil(n_buckets / RANGE_BUCKETS)))
    sums = [np.frombuffer(r.data, np.int64) for r in totals.where("kind = 's'").select("data").collect()]  # a few numbers for each range
    tokens, types, *few = (int(x) for x in np.sum(sums, axis=0)) if sums else [0] * (LAST + 3)
    blocks = steps.write("blocks", numbered_blocks(hashed, totals))
    steps.drop("hashed", "words")
    model = Model(steps, blocks, Words(tokens, few), size.train or 0, n_buckets)
    while len(model.d) < order:
        model.add_order()
    ddl = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    out = arrow_schema(ddl)

    def finish(number: int, block: Block, levels: list[Level]) -> Iterator[pa.RecordBatch]:
        n = len(block.lengths)
        base = np.bincount(block.doc, np.log10((block.c1 + 1.0) / (tokens + types + 1)), n)
        known = np.bincount(block.doc, block.c1 > 0, n).astype(np.int64)
        ids = block.rows.astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(block.lengths), pa.array(known), pa.array(base), pa.array(np.bincount(block.doc, levels[-1].logp, n))], schema=out
        )

    scored = model.each_block(finish, ddl).withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
    return scored.select(
        "doc_id", remainder_is("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
