"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from sitelake.llm import collocations as module
from sitelake.llm.collocations import collocations, count_pairs
from sitelake.llm.tables import Steps

SCHEMA = "doc_id bigint, text string, lang string, id bigint, f bigint, words string, a bigint, block int"


def brute(rows, least=10, longest=3, covered=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        named = {p for p, n in f.items() if len(p) > 1 and n >= least}
        longer = Counter()
        for p in named:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f[p])
        found = []
        for p in named:
            a = f[p]
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < covered * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return Counter(out)


def sample():
    rng = random.Random(11)
    words = ["the", "of", "New", "york", "city", "é", "한국", "\x00", "x\xa0y", *(f"w{i}" for i in range(60))]
    weights = [30, 20, 8, 8, 8, 5, 5, 2, 2, *[1] * 60]
    rows = []
    for _ in range(400):
        text = "".join(w + rng.choice([" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "\r", "?!", ":"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((text.replace("york", "york city") if rng.random() < 0.3 else text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "zz"), (" \t\n", "yy"), ("one two", "xx"), ("a b c d " * 12, "ties"), ("go go go go " * 9, "same"), ("ab ba " * 4_000, "en")]
    return rows + [rows[3]] * 30


def test_against_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "w", 3, 4) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    found = collocations(docs)
    assert dict(found.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")}
    assert Counter(map(tuple, found.collect())) == brute(rows)
    monkeypatch.setattr(module, "BLOCK_BYTES", 600)  # texts that span blocks
    assert Counter(map(tuple, collocations(docs, longest=4, covered=80, top=7).collect())) == brute(rows, longest=4, covered=80, top=7)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, 1, 2, "w", 3, 4)], SCHEMA)).count() == 0


def test_tiles_count_like_a_plain_count():
    rng = np.random.default_rng(2)
    a, b = (np.concatenate([rng.integers(0, 200, 30_000), rng.integers(0, 90_000, 5_000)]) for _ in range(2))
    found = {(int(x), int(y)): int(n) for x, y, n in zip(*count_pairs(a, b))}
    assert found == Counter(zip(a.tolist(), b.tolist()))
    assert len(count_pairs(a[:0], b[:0])[0]) == 0


def test_blocks_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 10)
    data = b"aaaa bb cc dd\xffee\xff" + b"f" * 40
    assert list(module.chunks(data)) == [b"aaaa bb cc dd", b"ee\xff" + b"f" * 40] and list(module.chunks(b"")) == [b""]


def test_tasks_hold_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(module, "GROUP_BYTES", 60_000, raising=False)
    rng, plans = random.Random(4), {}
    rows = [(i, " ".join(f"w{int(3_000 * rng.random() ** 4)}" for _ in range(3_000)), "en", 1, 2, "w", 3, 4) for i in range(40)]
    written = Steps.write

    def write(self, name, df, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        self.folder = str(tmp_path / "steps")
        return written(self, name, df, *more)

    monkeypatch.setattr(Steps, "write", write)
    monkeypatch.setattr(Steps, "drop", lambda *_: None)
    found = collocations(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert Counter(map(tuple, found.collect())) == brute([(r[1], r[2]) for r in rows])
    # The lists of many blocks are never gathered at once, and a group of written rows ends by bytes, not after 100 rows.
    assert all("collect_list" not in plans[name] for name in ("coded", "coded-2"))
    for name in ("blocks", "coded", "coded-2"):
        groups = [m.row_group(i) for m in map(pq.read_metadata, (tmp_path / "steps" / name).glob("*.parquet")) for i in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) > 15 and max(g.num_rows for g in groups) < 5
