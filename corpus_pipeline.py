"""Corpus pipeline: rejects poor documents, removes what repeats, and packs the rest into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from corpusq.llm.common import staged, table
from corpusq.llm.plans import quality_model, vocabulary
from corpusq.session import bound_batches

MIN_SCORE = 0.7
BATCH_BYTES = 4 << 20  # of rows handed to a Python worker at once


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """Rows with a new text; n_chars follows it, null texts have become empty."""
    return docs.withColumns({"text": text, "n_chars": F.char_length(text).cast("long")}).select(columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null text is judged as an empty one."""
    bound_batches(spark, BATCH_BYTES)
    score = quality.scorer(quality_model(spark, docs, sf_dir))
    return docs.where(score(F.col("text")) >= MIN_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go. A document stays, if with an empty text."""
    cleaned = line_dedup.dedup_lines(docs, result_col="_line_dedup")
    return _with_text(cleaned, F.col("_line_dedup.text"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays. Rows of one id stay or go together."""
    bound_batches(spark, BATCH_BYTES)
    classes = ngram_join.ngram_join(docs)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier go; the rest is joined."""
    bound_batches(spark, BATCH_BYTES)
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = suffix_dedup.remove_repeats(docs, carry=carry, as_text=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cleaned.select(*[new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("packing", packing_stage),
]

# A trained model and a tokenizer are beyond SQL; tests/llm/test_llm_pipeline.py has a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
