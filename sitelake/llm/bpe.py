"""BPE encoding and decoding: a minimal acyclic transducer holds frequent words with their ids, other words are merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim, texts_of

#: The lexicon holds at most so many words, the most frequent of those found at least so often.
LEXICON_WORDS, LEAST_COUNT = 200_000, 8
#: Entries of each half of a worker's caches, and of a task's word counts before they are passed on.
CACHE, COUNTED = 200_000, 400_000
#: Text whose words are looked up together.
GROUP_CHARS = 4_000_000

#: White space as the tokenizer's patterns see it. Python's split() would also cut at the four separators U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(f"[^{SPACE}]+")
# The tokenizer file's own pattern, a fixed value.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


def chunks_of(text: str) -> list[str]:
    """Runs without white space; no token crosses their ends."""
    return CHUNK.findall(text) if SEPARATORS.search(text) else text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or one from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(own))
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def normal(chunk: str) -> str:
    """Composed and in small letters, letter by letter: the tokenizer knows no special form of the Greek sigma at the end of a word."""
    return chunk.lower() if chunk.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))


NO_RANK = 1 << 40


class BpeModel:
    """Vocabulary and merges of a word-level BPE file: NFC, lower case, pieces by pattern, byte letters, an end-of-word mark."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> rank, merged id
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        keys = np.fromiter(((a << 32) | b for a, b in self.merges), np.int64, len(self.merges))
        ranks, made = (np.fromiter((m[k] for m in self.merges.values()), np.int64, len(self.merges)) for k in (0, 1))
        order = np.argsort(keys)
        self.pairs = keys[order], ranks[order]
        self.made = np.zeros(len(merges), np.int64)
        self.made[ranks] = made
        self.first_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the pair of lowest rank, the leftmost of equals, until none is left."""
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.merges.get, (1 << 30, 0)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == 1 << 30:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where there is no merge, or an id is missing (-1)."""
        keys, ranks = self.pairs
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (right >= 0) & (left >= 0), ranks[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """What `merge` gives for each piece: in each round all pieces make their next merge together."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            least = len(pieces[order[at]])
            if least > 48 or not self.merges:
                out[order[at]] = self.merge(pieces[order[at]])
                at += 1
                continue
            end = at
            while end < len(order) and len(pieces[order[end]]) <= min(48, least + 3):
                end += 1
            self._merge_rows([pieces[i] for i in order[at:end]], order[at:end], out)
            at = end
        return out

    def _merge_rows(self, pieces: list[bytes], places: list[int], out: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        column = np.arange(width + 1)
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[column[None, :] < sizes[:, None]] = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.arange(len(pieces))
        ids[row, sizes - 1] = self.last_ids[np.frombuffer(bytes(p[-1] for p in pieces), np.uint8)]
        ranks = np.full(ids.shape, NO_RANK, np.int64)
        ranks[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])
        place = np.array(places)
        while True:
            i = ranks.argmin(1)
            best = ranks[np.arange(len(ranks)), i]
            done = best == NO_RANK
            if done.any():
                for where, found in zip(place[done].tolist(), ids[done].tolist()):
                    out[where] = [t for t in found if t >= 0]
                ids, ranks, place, i, best = ids[~done], ranks[~done], place[~done], i[~done], best[~done]
            if not len(place):
                return
            row = np.arange(len(place))
            ids[row, i] = self.made[best]
            # The right one of the pair goes, and all after it move up; so do the ranks of the pairs.
            ids = np.take_along_axis(ids, np.minimum(column + (column > i[:, None]), width), 1)
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= i[:, None]), width), 1)
            ids[:, -1] = -1
            ranks[row, i] = self.ranks_of(ids[row, i], ids[row, np.minimum(i + 1, width)])
            inner = i > 0
            ranks[row[inner], i[inner] - 1] = self.ranks_of(ids[row[inner], i[inner] - 1], ids[row[inner], i[inner]])

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """What `encode_chunk` gives for each chunk; pieces of all are merged together."""
        cut: list[list[str] | None] = []
        for chunk in chunks:
            if self.special and "<" in chunk and self.special.search(chunk):
                cut.append(None)
                continue
            plain = normal(chunk)
            cut.append([plain] if plain.isalpha() else PIECE.findall(plain))
        pieces = list({p for found in cut if found for p in found})
        ids = dict(zip(pieces, self.merge_all([p.encode("utf-8", "surrogatepass") for p in pieces])))
        return [self.encode_chunk(chunk) if found is None else [i for p in found for i in ids[p]] for chunk, found in zip(chunks, cut)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := get((made, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [t for t in ids if t >= 0]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a run without white space."""
        if self.special and "<" in chunk and self.special.search(chunk):
            out, at = [], 0
            for found in self.special.finditer(chunk):
                out += self._plain(chunk[at : found.start()]) + [self.added[found.group()]]
                at = found.end()
            return out + self._plain(chunk[at:])
        return self._plain(chunk)

    def _plain(self, chunk: str) -> list[int]:
        return [i for piece in PIECE.findall(normal(chunk)) for i in self.merge(piece.encode("utf-8", "surrogatepass"))]

    def encode(self, text: str) -> list[int]:
        return [i for chunk in chunks_of(text) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks; the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def compile_lexicon(words: dict[str, list[int]], path: str) -> None:
    """Write a minimal acyclic automaton of the words, numbered in byte order, with the ids of each number.

    Words are added in order; states that can no longer change are replaced by an equal one met before, so endings are shared. Each
    edge carries how many words sort before those behind it, so that walking a word sums up its number.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    keys = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
    stack: list[list] = [[False, []]]  # the open path: final, closed edges; labels on the way are those of the last word
    last = b""
    for word, _ in keys:
        common = len(os.path.commonprefix([last, word]))
        while len(stack) - 1 > common:
            node = stack.pop()
            stack[-1][1].append((last[len(stack) - 1], freeze(node)))
        stack += [[False, []] for _ in range(len(word) - common)]
        stack[-1][0] = True
        last = word
    while len(stack) > 1:
        node = stack.pop()
        stack[-1][1].append((last[len(stack) - 1], freeze(node)))
    root = freeze(stack[0])
    sizes = [0] * len(states)
    first, labels, targets, skips, finals = array("I", [0]), bytearray(), array("I"), array("I"), bytearray()
    for s, (final, edges) in enumerate(states):  # the states behind an edge come first
        count = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(count)
            count += sizes[target]
        sizes[s] = count
        first.append(len(labels))
        finals.append(final)
    starts, flat = array("I", [0]), array("I")
    for _, ids in keys:
        flat.extend(ids)
        starts.append(len(flat))
    parts = [first.tobytes(), targets.tobytes(), skips.tobytes(), starts.tobytes(), flat.tobytes(), bytes(finals), bytes(labels)]
    with open(path, "wb") as out:
        out.write(array("Q", [root, *map(len, parts)]).tobytes())
        for part in parts:
            out.write(part)


class Lexicon:
    """A compiled lexicon, mapped into memory and shared by all processes of a machine."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = memoryview(self.map)[:64].cast("Q")
        self.root, at, parts = head[0], 64, []
        for n in head[1:]:
            parts.append((at, at + n))
            at += n
        whole = memoryview(self.map)
        self.first, self.targets, self.skips, self.starts, self.ids = (whole[a:b].cast("I") for a, b in parts[:5])
        self.finals = whole[slice(*parts[5])]
        self.labels_at = parts[6][0]
        #: Edges as state and label in one number, ascending, for many words at a time.
        first = np.frombuffer(self.first, np.uint32).astype(np.int64)
        labels = np.frombuffer(whole[slice(*parts[6])], np.uint8)
        self.edges = (np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8) | labels
        self.steps = np.frombuffer(self.targets, np.uint32), np.frombuffer(self.skips, np.uint32)

    def find(self, word: str) -> list[int] | None:
        """Ids of a word; None if the lexicon does not have it."""
        state, number, find, at = self.root, 0, self.map.find, self.labels_at
        for b in word.encode("utf-8", "surrogatepass"):
            edge = find(b.to_bytes(), at + self.first[state], at + self.first[state + 1]) - at
            if edge < 0:
                return None
            number += self.skips[edge]
            state = self.targets[edge]
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist() if self.finals[state] else None


    def find_all(self, words: list[str]) -> list[list[int] | None]:
        """What `find` gives for each word: all walk the automaton together, a byte at a time."""
        if not len(self.edges):
            return [None] * len(words)
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(coded), np.uint8)
        targets, skips = self.steps
        state, number = np.full(len(coded), self.root, np.int64), np.zeros(len(coded), np.int64)
        walking, at = np.flatnonzero(sizes > 0), 0
        lost = sizes == 0
        while len(walking):
            wanted = (state[walking] << 8) | data[begins[walking] + at]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            there = self.edges[edge] == wanted
            lost[walking[~there]] = True
            walking, edge = walking[there], edge[there]
            number[walking] += skips[edge]
            state[walking] = targets[edge]
            at += 1
            walking = walking[sizes[walking] > at]
        return [
            None if gone or not self.finals[s] else self.ids[self.starts[n] : self.starts[n + 1]].tolist()
            for gone, s, n in zip(lost.tolist(), state.tolist(), number.tolist())
        ]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each run without white space is found, over all texts."""
    out = arrow_schema("word string, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=out)
            counts.clear()
            return done

        for batch in batches:
            for text in texts_of(batch):
                counts.update(chunks_of(text))
                if len(counts) > COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return slim(docs, text=text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, model_path: str, text_col: str = "text", words: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> str:
    """Compile the most frequent words of the corpus, encoded, and send the file to all executors; returns its name there.

    Words are counted over all texts; the driver gets at most `words` of them. They only save time: results do not depend on them.
    """
    model = BpeModel(model_path)
    frequent = word_counts(docs, text_col).where((F.col("n") >= least) & (F.length("word") <= 64)).orderBy(F.desc("n"), "word").limit(words)
    found = frequent.select("word").toArrow().column("word").to_pylist()
    table = dict(zip(found, model.encode_chunks(found)))
    path = Path(tempfile.mkdtemp(prefix="sitelake-lexicon-")) / f"lexicon-{uuid.uuid4().hex}.bin"
    compile_lexicon(table, str(path))
    docs.sparkSession.sparkContext.addFile(str(path))
    return path.name


_shipped: dict[str, str] = {}


def ship_model(spark: SparkSession, model_path: str) -> str:
    """Send the tokenizer file to all executors under its own name; returns that name."""
    key = f"{spark.sparkContext.applicationId}:{model_path}"
    if key not in _shipped:
        spark.sparkContext.addFile(model_path)
        _shipped[key] = os.path.basename(model_path)
    return _shipped[key]


_coders: dict[tuple[str, str | None], Coder] = {}


class Coder:
    """Chunk -> ids as text, tokens as text, number of ids; from the lexicon or by merging.

    The last used chunks are kept in two halves: when the young one is full it becomes the old one, and what is used of that is taken
    over, so frequent chunks stay while rare ones go.
    """

    def __init__(self, model: BpeModel, lexicon: Lexicon | None):
        self.model, self.lexicon = model, lexicon
        self.young: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}
        self.written = {i: str(i) for i in model.tokens}

    def know(self, chunks: set[str]) -> dict[str, tuple[str, str, int]]:
        """The entries, with those of all given chunks among them."""
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        young, old, tokens, written = self.young, self.old, self.model.tokens, self.written
        new = []
        for chunk in chunks.difference(young):
            known = old.get(chunk)
            if known is None:
                new.append(chunk)
            else:
                young[chunk] = known
        found = self.lexicon.find_all(new) if self.lexicon else [None] * len(new)
        unseen = iter(self.model.encode_chunks([chunk for chunk, ids in zip(new, found) if ids is None]))
        for chunk, ids in zip(new, found):
            ids = next(unseen) if ids is None else ids
            young[chunk] = (" ".join([written[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))
        return young

    @staticmethod
    def of(model: str, lexicon: str | None) -> Coder:
        """The worker's own, kept from task to task."""
        if (model, lexicon) not in _coders:
            _coders.clear()
            _coders[model, lexicon] = Coder(BpeModel(SparkFiles.get(model)), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        return _coders[model, lexicon]


def in_groups(rows: Iterable[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    """Rows in groups of about GROUP_CHARS of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(
    docs: DataFrame, model_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens and ids; with `digests`, SHA-256 of the ids and of the decoded text instead of ids.

    `lexicon` is the name that build_lexicon returned; without one every word is merged, to the same ids. Digests are taken where the
    ids are made, so that ids need not travel. Null and empty texts have no token. Equal texts have equal ids; null ids of rows stay
    null; other columns are left out. No shuffle, and no text is held but those of a batch.
    """
    model = ship_model(docs.sparkSession, model_path)
    ddl = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    out = arrow_schema(ddl)
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(model, lexicon)
        for batch in batches:
            rows = []
            for group in in_groups(zip(batch.column("doc_id").to_pylist(), texts_of(batch))):
                chunked = [(doc_id, chunks_of(text)) for doc_id, text in group]
                known = coder.know(set().union(*(chunks for _, chunks in chunked)))
                for doc_id, chunks in chunked:
                    found = [f for f in map(known.__getitem__, chunks) if f[2]]
                    ids, tokens, sizes = zip(*found) if found else ((), (), ())
                    written = " ".join(ids)
                    if digests:
                        rows.append((doc_id, sum(sizes), sha(written), sha(" ".join(tokens))))
                    else:
                        rows.append((doc_id, sum(sizes), list(map(int, written.split()))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, ddl)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids. Null ids give a null text, no ids an empty one; an id outside the vocabulary is an error."""
    model = ship_model(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(model, None)
        for batch in batches:
            texts = [None if ids is None else coder.model.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id bigint, text string")
