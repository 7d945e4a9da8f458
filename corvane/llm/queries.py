"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, line_dedup, packing, quality, simhash, substring_dedup, tokenfile, warc
from ._shared import read_table, scratch_path


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    tokenfile.write_token_files(read_table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.token_file_digests(spark, out)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, respace=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), out)
    found = warc.read_archives(spark.read.parquet(out), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), max_bits=4, shingle_words=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe_round_trip, op2_token_files, op3_exact_dedup, op4_substring_dedup, op5_quality_rules, op6_best_fit_packing, op7_html_extraction, op8_warc_round_trip, op9_line_dedup, op10_simhash)}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY body)
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), numbered AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines
        ), keyed AS (
            SELECT doc_id, i, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM numbered
        ), common AS (
            SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c ON keyed.k = c.k GROUP BY doc_id
    """,
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
        ), windows AS (
            SELECT s.doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM starts s JOIN d USING (doc_id)
        ), ranked AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM windows
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE k > 1
        ), words AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
        ), kept AS (
            SELECT words.doc_id, count(*) AS n_words, count(c.p) AS n_removed,
                   string_agg(x, ' ' ORDER BY words.p) FILTER (c.p IS NULL) AS t
            FROM words LEFT JOIN covered c ON words.doc_id = c.doc_id AND words.p = c.p GROUP BY words.doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}
