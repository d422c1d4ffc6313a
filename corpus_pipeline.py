"""A corpus pipeline over the documents table: each stage works on all that its predecessor kept.

Stages but the last return the columns of documents. Which rows and texts they keep: `toxicity` drops documents that the model
rejects; `near_duplicates` keeps one row, of smallest id, of each group of near copies, and those without id or words; `passages` removes
repeated passages but their first place, and documents of which nothing is left; `mix` repeats or drops whole documents by the words
that the source mix takes of them; `encode` returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.bpe import build_lexicon
from sitelake.llm.bpe import encode as bpe_encode
from sitelake.llm.jaccard import jaccard_components
from sitelake.llm.mixing import mixed_documents
from sitelake.llm.queries import tokenizer_path
from sitelake.llm.suffixes import remove_repeats
from sitelake.llm.tables import ROW, with_rows
from sitelake.llm.toxicity import harmless, train_toxicity
from sitelake.session import apply_settings, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def ready(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    run_stage.__doc__ = stage.__doc__
    return run_stage


@ready
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below the threshold; the model learns from labelled ones of its input.

    Null and empty texts have the least score and stay; equal texts share their fate, so repeated rows stay or go together, and a score
    equal to the threshold goes. Rows without id are scored and never learnt from. Columns are carried as they are; an empty table gives
    an empty result.
    """
    return harmless(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@ready
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, a row of smallest id, of each group linked by shingles of five words at a similarity of 0.8.

    Rows without id, and null, empty and blank texts, are in no group and stay. Of rows with the smallest id of a group one stays, by a
    fixed order. Columns are carried as they are; an empty table gives an empty result.
    """
    rows = with_rows(docs, "near")
    linked = jaccard_components(rows, row_col=ROW).where("component is not null")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "a", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    others = linked.select(ROW).join(first, ROW, "left_anti")
    return rows.join(others, ROW, "left_anti").select(*(f"`{c}`" for c in docs.columns))


#: Bytes from which a repeated string goes: less than 50 words of any length have.
PASSAGE_BYTES = 200


@ready
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of PASSAGE_BYTES bytes; documents of which only white space is left go.

    The first place of a string, by id, then place, keeps it. Null, empty and short texts stay as they are, as do documents that lose
    nothing; a null id comes last; repeated rows count as one place. `n_chars` follows the text; other columns are carried, whatever
    their names. An empty table gives an empty result.
    """
    held = {name: f"__passages_{i}" for i, name in enumerate(docs.columns)}
    given = docs.select(*(F.col(f"`{name}`").alias(new) for name, new in held.items()))
    left = remove_repeats(given, id_col=held["doc_id"], text_col=held["text"], length=PASSAGE_BYTES, carry=list(held.values()))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col(held["text"]))
    made = {"text": text, "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col(held["n_chars"]))}
    kept = left.where(~(changed & (F.length(F.trim("kept_text")) == 0)))
    return kept.select(*(made.get(name, F.col(new)).alias(name) for name, new in held.items()))


@ready
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the source mix takes them.

    Null, empty and blank texts have nothing to give and go. A null source is a source of its own; rows are told apart by number, so ids
    may be null or repeated. Columns are carried as they are; an empty table gives an empty result.
    """
    return mixed_documents(docs)


@ready
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids. Null and empty texts have none, equal texts have equal ids; an empty table gives an empty result."""
    return bpe_encode(docs, tokenizer_path(), build_lexicon(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("encode", encode),
]
#: Training, suffix order and token ids are beyond SQL; stages and run() are tested in tests/llm/test_pipeline_rows.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
