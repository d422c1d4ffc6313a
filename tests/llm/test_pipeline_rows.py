"""Stages of the pipeline over rows with null, repeated and clashing ids."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from sitelake.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t)) for i, t, s in rows], SCHEMA)


def make(k, n=60):
    rng = random.Random(k)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_near_duplicates_by_row(spark):
    near = make(1) + " end"
    rows = [(1, make(1), "a"), (1, make(1), "a"), (2, near, "a"), (2, make(2), "a"), (3, make(3), "a"), (3, make(3), "b"), (None, make(1), "a"), (None, make(1), "a"), (4, "", "a"), (4, "", "a")]
    rows += [(5, make(5), "a"), (6, make(5), "a"), (5, make(6), "a"), (7, make(6), "a")]  # two groups of one smallest id
    found = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    assert found == Counter({(1, make(1)): 1, (2, make(2)): 1, (3, make(3)): 1, (None, make(1)): 2, (4, ""): 2, (5, make(5)): 1, (5, make(6)): 1})


def test_mixed_documents_by_row(spark):
    rows = [(None, make(0), "a")] * 40 + [(7, make(7), "b")] * 9 + [(7, make(8, 20), "b")] + [(k, make(k), "c") for k in range(100, 140)]
    docs = frame(spark, rows)
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    size = lambda rs: Counter({s: sum(len(t.split()) for _, t, x in rs if x == s) for s in "abc"})
    mixed, given = size([(r.doc_id, r.text, r.source) for r in found.collect()]), size(rows)
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(mixed[s] <= 2 * given[s] and abs(mixed[s] - target[s]) <= 0.25 * target[s] for s in "abc"), (mixed, target)


def later_copies(rows, length):
    """Brute force: bytes of a text in a string of `length` bytes that begins earlier, by id and place, and what is left of it."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = t.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        out[i] = bytes(c for c, g in zip(data, gone) if not g).decode()
    return out


def test_passages_stage(spark):
    shared, other = make(50, 45), make(51, 70)
    assert 200 < len(shared) < 400
    rows = [(1, make(1)), (2, make(2) + " " + shared + " " + make(3)), (3, shared), (4, make(4) + shared), (5, other + " x " + other), (6, ""), (7, "short"), (8, make(8) + shared[:199]), (None, make(9) + other)]
    clash = "spans string, n_removed int, n_bytes int, n_spans int, kept_sha256 string, kept_text string, row int, `__row` int, `a.b` int"
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t), "p", 1, 2, 3, "q", "k", 4, 5, 6) for i, t in rows] + [(10, None, "xx", "s", 0, "p", 1, 2, 3, "q", "k", 4, 5, 6)], f"{SCHEMA}, {clash}")
    found = corpus_pipeline.passages(spark, docs.repartition(3), "")
    assert found.columns == docs.columns
    left = {r.doc_id: (r.text, r.n_chars, r.spans, r.n_bytes, r["a.b"]) for r in found.collect()}
    wanted = {i: (t, len(t), "p", 2, 6) for i, t in later_copies(rows, 200).items() if i != 3}
    assert left == wanted | {10: (None, 0, "p", 2, 6)}
    assert corpus_pipeline.passages(spark, docs.limit(0), "").count() == 0


def test_mix_with_clashing_names(spark):
    docs = spark.createDataFrame([(k, make(k), "xx", "ab"[k % 2], 3, 1, 2, 3, 4) for k in range(40)], f"{SCHEMA}, `__copies` int, `__copy` int, `__row` int, taken int")
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns and {tuple(r)[5:] for r in found.collect()} == {(1, 2, 3, 4)}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def write_tables(spark, folder, rows, labels, extra=""):
    spark.createDataFrame(rows, SCHEMA + extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vilebad", "grotmonger"]))
        rows.append((i, " ".join(words), "xx", "ab"[i % 2]))
        if i % 3 < 2:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_stage(spark, tmp_path):
    rows, labels = toxic_rows()
    rows += [(None, "kind words only", "xx", "a"), (None, "so vilebad", "xx", "a"), (900, None, "xx", "a"), (901, "", None, None), rows[0], rows[1]]
    full = [(i, t, lang, s, 0, 0.5, "p") for i, t, lang, s in rows]
    docs = write_tables(spark, str(tmp_path), full, labels, ", score double, predicted string")
    found = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in found.collect())
    bad = lambda t: any(w in (t or "") for w in ("vilebad", "grotmonger"))
    assert kept == Counter((i, t) for i, t, _, _ in rows if not bad(t))
    assert corpus_pipeline.toxicity(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_whole_run(spark, tmp_path):
    from tokenizers import Tokenizer

    from sitelake.llm.queries import tokenizer_path

    rows, labels = toxic_rows()
    shared = make(60, 45)
    rows += [(1_000 + k, make(100 + k) + " " + shared + " " + make(200 + k), "xx", "a") for k in range(3)]
    rows += [(2_000, rows[1][1] + " tail", "xx", "b"), (2_001, rows[1][1], "xx", "b"), (2_002, "", "xx", "b"), (2_003, shared, "xx", "b")]
    docs = write_tables(spark, str(tmp_path), [(i, t, lang, s, len(t)) for i, t, lang, s in rows], labels)
    # By hand: toxic texts go, of near copies the first stays, later copies of the passage go, and with them texts that are nothing else.
    left = [(i, t, s) for i, t, _, s in rows if "vilebad" not in t and "grotmonger" not in t and i not in (2_000, 2_001)]
    cut = later_copies([(i, t) for i, t, _ in left], corpus_pipeline.PASSAGE_BYTES)
    left = [(i, cut[i], s) for i, _, s in left if i != 2_003]
    source = spark.createDataFrame([(i, t, "xx", s, len(t)) for i, t, s in left], SCHEMA)
    mixed = [r.text for r in mixing.mixed_documents(source).collect()]
    coder = Tokenizer.from_file(tokenizer_path())
    coder.no_padding()
    coder.no_truncation()
    wanted = Counter(tuple(coder.encode(t, add_special_tokens=False).ids) for t in mixed)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter(tuple(r.ids) for r in found)
    assert got.keys() <= set(map(lambda t: tuple(coder.encode(t, add_special_tokens=False).ids), (t for _, t, _ in left)))
    assert sum((got - wanted).values()) + sum((wanted - got).values()) <= 0.05 * len(mixed)  # rows are numbered anew, so equal ranks may trade places
    assert docs.count() == len(rows)
