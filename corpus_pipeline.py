"""From raw documents to packed training sequences.

Five stages, each an operator of ``corvane.llm``, applied to the documents that
the one before it kept. Every stage's rows are written as Parquet to the
shared folder and read again, so no lineage grows and a lost executor costs at
most one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import line_dedup, near_copies, packing, quality, substring_dedup
from corvane.llm._shared import drop_scratch, materialize, read_table, scratch_mark
from corvane.llm.queries import tokenizer_path

TOKENIZER, CAPACITY = "word_bpe_49k.json", 2048


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the character count brought up to date."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs, read_table(spark, sf_dir, "labels"))


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them."""
    return _as_documents(line_dedup.line_dedup(docs, min_docs=10), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) the document with the
    smallest id stays: op 10's index proposes, exact similarity verifies and completes."""
    return near_copies.first_of_each(docs, percent=80, shingle_words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier go."""
    return _as_documents(substring_dedup.substring_dedup(docs, window=20), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER), end_id=0, capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", common_lines),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: XXH64 and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote beside its result goes once the result is stored, and so does
    the result once the next one is; the last stage's tables stay for whoever reads the rows."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        began = scratch_mark(spark)
        result = stage(spark, docs, sf_dir)
        ended = scratch_mark(spark)
        docs = materialize(result, name.replace(" ", "-"))
        drop_scratch(spark, began, ended)
        if before is not None:
            drop_scratch(spark, before, before + 1)
        before = ended
    return STAGES[-1][1](spark, docs, sf_dir)
