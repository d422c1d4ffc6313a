"""Toxicity by multiple-instance learning: sentence probabilities combined by noisy-or, learned from document labels alone."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, remainder_is, slim, texts_of
from sitelake.session import cut_lineage

#: The classifier is fitted on at most so many labelled texts, those of smallest id hash.
FIT_ROWS = 20_000
#: At most so many features, those that most exceed their expected count in toxic texts.
FIT_FEATURES = 4_000
#: A feature is tried if it is in so many different toxic texts and exceeds the expected number by so many standard deviations.
LEAST_TOXIC, LEAST_Z = 4, 4.0
THRESHOLD = 0.7

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature and the bias of a sentence that has any of them."""

    weights: dict[str, float]
    bias: float
    n_rows: int = 0


def features(word: str) -> tuple[str, ...]:
    """A word as a whole, and its beginnings of four and five letters, which join the forms of one stem."""
    return (word + "$",) if len(word) < 5 else (word + "$", word[:4]) if len(word) == 5 else (word + "$", word[:4], word[:5])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id_col: str, rows: int) -> DataFrame:
    """The labelled texts to learn from: without held-out ids, null labels and repeated texts, at most `rows`."""
    marked = (
        slim(labels, doc_id=label_id_col, toxic=label_col)
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~remainder_is("doc_id", 3, 1))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most `rows` pairs of small numbers, so this side can always be broadcast and no text is shuffled to find its label.
    chosen = slim(docs, doc_id=id_col, text=text_col).join(F.broadcast(marked), "doc_id")
    return chosen.groupBy("text").agg(F.max("toxic").alias("toxic")).where(F.length("text") > 0)


def feature_counts(rows: DataFrame) -> DataFrame:
    """In how many texts, and how many toxic ones, each feature is."""
    out = arrow_schema("feature string, n bigint, n_toxic bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                for f in {f for w in set(TOKEN.findall(text.lower())) for f in features(w)}:
                    c = seen.setdefault(f, [0, 0])
                    c[0] += 1
                    c[1] += toxic
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen)), pa.array([c[0] for c in seen.values()]), pa.array([c[1] for c in seen.values()])], schema=out
                )

    return rows.mapInArrow(count, "feature string, n bigint, n_toxic bigint").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")
    )


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id",
    fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, epochs: int = 400, penalty: float = 0.5,
) -> ToxicityModel:
    """Fit the sentence model on labelled texts whose id is not held out (crc32 modulo 3 is not 1).

    A text is toxic if any of its sentences is: P = 1 - prod(1 - p_s), p_s = sigmoid(bias + sum of weights) for a sentence that has a
    feature, 0 for others. Weights are not negative, so harmless words cannot outweigh an offence; `penalty` shrinks them, the more so the fewer texts there are. The log-likelihood of the labels is climbed by gradient steps on the driver, over at most `fit_rows` texts
    reduced to their known features. Without a toxic or without a clean text the model has no feature and scores everything 0.
    """
    rows = cut_lineage(training_rows(docs, labels, id_col, text_col, label_col, label_id_col, fit_rows))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not total.toxic or total.toxic == total.n:
        return ToxicityModel({}, -20.0, total.n)
    share = total.toxic / total.n
    excess = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = (
        feature_counts(rows).where((F.col("n_toxic") >= LEAST_TOXIC) & (excess >= LEAST_Z))
        .orderBy(excess.desc(), "feature").limit(fit_features).select("feature").collect()
    )
    vocabulary = {r.feature: i for i, r in enumerate(sorted(chosen))}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts_of(batch):
                sentences = []
                for s in SENTENCE.findall(text.lower()):
                    ids = {vocabulary[f] for w in TOKEN.findall(s) for f in features(w) if f in vocabulary}
                    if ids:
                        sentences.append(sorted(ids))
                found.append(sentences)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["toxic", "sentences"])

    bags = rows.mapInArrow(known, "toxic int, sentences array<array<int>>").collect()
    bags.sort(key=lambda r: (r.toxic, r.sentences))
    weights, bias = _fit([(r.sentences, r.toxic) for r in bags], len(vocabulary), epochs, penalty / len(bags))
    return ToxicityModel({f: float(weights[i]) for f, i in vocabulary.items() if abs(weights[i]) > 1e-3}, float(bias), total.n)


def _fit(bags: list[tuple[list[list[int]], int]], n_features: int, epochs: int, penalty: float) -> tuple[np.ndarray, float]:
    """Adam on the penalised negative log-likelihood of noisy-or bags."""
    doc_of, sentence_of, feature_of = [], [], []
    for d, (sentences, _) in enumerate(bags):
        for s in sentences:
            sentence_of += [len(doc_of)] * len(s)
            feature_of += s
            doc_of.append(d)
    doc_of, sentence_of, feature_of = (np.array(x, dtype=np.int64) for x in (doc_of, sentence_of, feature_of))
    y = np.array([t for _, t in bags], dtype=float)
    w, n_sentences = np.zeros(n_features + 1), len(doc_of)
    w[-1] = -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = np.bincount(sentence_of, w[feature_of], n_sentences) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))  # log of the probability that no sentence is toxic
        none = np.exp(clean)
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0)  # d log-likelihood / d(-clean)
        ds = pull[doc_of] * p
        grad = np.empty_like(w)
        grad[:-1] = np.bincount(feature_of, ds[sentence_of], n_features) / len(bags) - penalty * w[:-1]
        grad[-1] = ds.sum() / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        np.maximum(w[:-1], 0, out=w[:-1])
    return w[:-1], w[-1]


class _Weighted(dict):
    """Word -> its features that have a weight, or None; found once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...] | None:
        found = tuple(f for f in features(word) if f in self.weights) or None
        if len(self) > 200_000:
            self.clear()
        self[word] = found
        return found


def score_text(text: str, model: ToxicityModel, known: _Weighted) -> tuple[float, int, list[dict]]:
    """Noisy-or score, number of sentences, and the sentences of at least one half with their place and probability."""
    low = text.lower()
    if not any(map(known.__getitem__, set(TOKEN.findall(low)))):
        return 0.0, sum(1 for _ in SENTENCE.finditer(text)), []
    n_sentences, hits, clean = 0, [], 0.0
    for s in SENTENCE.finditer(low if len(low) == len(text) else text):
        n_sentences += 1
        found = {f for w in TOKEN.findall(s.group().lower()) for f in known[w] or ()}
        if found:
            z = model.bias + sum(model.weights[f] for f in sorted(found))
            p = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
            clean += math.log1p(-min(p, 1 - 1e-9))
            if p >= 0.5:
                hits.append({"start": s.start(), "end": s.end(), "score": p})
    return abs(math.expm1(clean)), n_sentences, hits


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_sentences and the offending sentences.

    `offending` lists start, end (code points) and probability of each sentence of at least one half. Null and empty texts have no
    sentence and score 0. Equal texts score alike; null ids stay null and are not held out; other columns are left out. No shuffle.
    """
    ddl = "doc_id bigint, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weighted(model.weights)
        for batch in batches:
            rows = [(i, *score_text(t, model, known)) for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    scored = slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, ddl)
    return scored.select(
        "doc_id", remainder_is("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_sentences", "offending",
    )


def harmless(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weighted(model.weights)
        for batch in batches:
            yield batch.filter(pa.array([score_text(t, model, known)[0] < threshold for t in texts_of(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
