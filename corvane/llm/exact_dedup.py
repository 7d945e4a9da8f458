"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial of its bytes modulo two 31-bit primes.
Chunks are hashed independently; the hash of a concatenation is
``hash(left) * base ** len(right) + hash(right)``, so that a huge document is
the combination of its chunks in any order of evaluation: texts beyond
``HUGE_BYTES`` are cut, their chunks are hashed by different tasks, and the
shifted hashes add up. Rows with equal fingerprint and length are then compared
chunk by chunk: all copies of a chunk must have one content. That comparison is
an aggregation with map-side combining, so a group that holds a third of all
rows costs each task one row per chunk. Texts are read a second time for it
rather than moved; those without company are told by a bit filter of fixed
size, whose errors cost work only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii, materialize, text_column

#: A composable hash of bytes.
Hash = Callable[[bytes], tuple[int, int]]
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 69_069_069)
#: Bytes hashed by one vector operation, and bytes compared at a time.
HASH_CHUNK, COMPARE_CHUNK = 4096, 65_536
#: Texts beyond it are hashed in chunks of this size by different tasks.
HUGE_BYTES = 1 << 20
#: Bits of the filter of fingerprints with company: 1 MB, about two million fingerprints at a tenth of errors.
FILTER_BITS = 1 << 23


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n - 1, -1, -1):
        out[i], x = x, x * base % prime
    return out


POWERS = [_powers(b, p, HASH_CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The fingerprint of a concatenation from those of its parts."""
    return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Polynomial hashes of ``data``; chunk hashes come from one matrix product."""
    if not data:
        return (0, 0)
    pad = -len(data) % HASH_CHUNK  # zeros in front leave the value as it is
    chunks = np.frombuffer(b"\0" * pad + data, np.uint8).reshape(-1, HASH_CHUNK).astype(np.uint64)
    out = []
    for base, prime, powers in zip(BASES, PRIMES, POWERS, strict=True):
        h, shift = 0, pow(base, HASH_CHUNK, prime)
        for c in (chunks @ powers % np.uint64(prime)).tolist():
            h = (h * shift + c) % prime
        out.append(h)
    return tuple(out)


def shifted(part: tuple[int, int], n_after: int) -> tuple[int, int]:
    """What a part adds to the fingerprint of a text with ``n_after`` bytes behind it."""
    return combine(part, (0, 0), n_after)


MARKS = ["doc_id", "fp", "n_bytes", "text_sha256"]


def _plain_fingerprints(rows: DataFrame, hash_of: Hash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, sha = [], [], []
            for x in batch.column(1).cast(pa.binary()).to_pylist():
                x = x.lower()  # of bytes: A-Z only
                a, b = hash_of(x)
                fp.append(a << 32 | b)
                n.append(len(x))
                sha.append(hashlib.sha256(x).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=MARKS)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, n_bytes long, text_sha256 string")


def _combined_fingerprints(rows: DataFrame, hash_of: Hash) -> DataFrame:
    """The same for huge texts: chunks are dealt out, hashed, shifted and added up. Repeated rows
    are chunked alike, so each chunk counts once and rows come back as often as they were."""
    size = HUGE_BYTES
    body = rows.select("doc_id", F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("body"), F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256"))
    body = body.withColumn("n_bytes", F.length("body").cast("long"))
    parts = body.select("doc_id", "h", "n_bytes", "text_sha256", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {size})")).alias("k"), "body")
    parts = parts.select("doc_id", "h", "n_bytes", "text_sha256", "k", F.expr(f"substring(body, int(k * {size} + 1), {size})").alias("piece")).repartition("h", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shifted(hash_of(x.lower()), n - k * size - len(x)) for x, k, n in zip(batch.column("piece").to_pylist(), batch.column("k").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "n_bytes", "text_sha256", "k")), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "h", "n_bytes", "text_sha256", "k", "a", "b"])

    kind, row = rows.schema["doc_id"].dataType.simpleString(), ["doc_id", "h", "n_bytes", "text_sha256"]
    hashed = parts.mapInArrow(run, f"doc_id {kind}, h long, n_bytes long, text_sha256 string, k long, a long, b long")
    once = hashed.groupBy(*row, "k").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("copies"))
    whole = once.groupBy(*row).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("copies").alias("copies"))
    fp = F.shiftleft(F.col("a") % PRIMES[0], 32).bitwiseOR(F.col("b") % PRIMES[1])
    return whole.select("doc_id", fp.alias("fp"), "n_bytes", "text_sha256", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


def fingerprints(docs: DataFrame, hash_of: Hash = fingerprint) -> DataFrame:
    """(doc_id, fp, n_bytes, text_sha256) of every row, of the text with A-Z lower-cased."""
    rows = docs.select(docs["doc_id"], text_column(docs).alias("text"))
    huge = F.octet_length("text") > HUGE_BYTES
    return _plain_fingerprints(rows.where(~huge), hash_of).unionByName(_combined_fingerprints(rows.where(huge), hash_of))


def _places(fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each fingerprint and length."""
    x = (fp.astype(np.uint64) ^ (n.astype(np.uint64) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([x >> np.uint64(41), (x >> np.uint64(17)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def company_filter(alike: DataFrame) -> np.ndarray:
    """A bit filter of rows (fp, n_bytes): words are joined by tasks, at most ``FILTER_BITS`` bits meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(*(batch.column(i).to_numpy() for i in (0, 1))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = alike.select("fp", "n_bytes").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.view(np.uint64)


def company_chunks(docs: DataFrame, held: np.ndarray, hash_of: Hash = fingerprint) -> DataFrame:
    """(fp, n_bytes, chunk, piece) of the texts whose fingerprint the filter holds, equal pieces of a batch once."""
    rows = docs.select(text_column(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.lower() for x in batch.column(0).cast(pa.binary()).to_pylist()]
            fp = np.array([a << 32 | b for a, b in map(hash_of, texts)], np.int64)
            n = np.array([len(x) for x in texts], np.int64)
            at = _places(fp, n)
            maybe = ((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
            found = {(int(fp[i]), int(n[i]), k, texts[i][k * COMPARE_CHUNK : (k + 1) * COMPARE_CHUNK]) for i in np.flatnonzero(maybe) for k in range(max(1, -(-int(n[i]) // COMPARE_CHUNK)))}
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["fp", "n_bytes", "chunk", "piece"])

    return rows.mapInArrow(run, "fp long, n_bytes long, chunk int, piece binary")


def exact_duplicates(docs: DataFrame, hash_of: Hash = fingerprint) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text. Rows that repeat a doc_id with the same text
    share the verdict of that id and each count in group_size; a null doc_id
    never stays if its group has another. Very long texts are hashed in parallel
    and compared whole. Other columns are not read.
    """
    key = ["fp", "n_bytes"]
    marks = materialize(fingerprints(docs, hash_of), "exact-marks")
    groups = materialize(marks.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")), "exact-groups")
    alike = groups.where("group_size > 1").select(*key)

    # Texts with company, cut into chunks; every chunk of a group must have one content.
    chunks = company_chunks(docs, company_filter(alike), hash_of)
    differ = chunks.groupBy(*key, "chunk").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b").select(*key).distinct()
    differ = differ.join(alike, key, "left_semi")
    differ = materialize(differ, "exact-differ")

    out = marks.join(groups, key)
    if not differ.isEmpty():  # unequal texts under one fingerprint: their texts are the key
        texts = docs.select(docs["doc_id"].alias("id"), F.encode(lower_ascii(text_column(docs)), "UTF-8").alias("body"))
        text_groups = (
            texts.withColumn("text_sha256", F.sha2("body", 256))
            .join(marks.join(differ, key, "left_semi").select(*key, "text_sha256").distinct(), "text_sha256")
            .groupBy(*key, "text_sha256", "body")
            .agg(F.count(F.lit(1)).alias("own_size"), F.max("id").alias("own_keep"))
            .drop("body")
        )
        out = out.join(text_groups, [*key, "text_sha256"], "left").withColumns({"group_size": F.coalesce("own_size", "group_size"), "keep_id": F.coalesce("own_keep", "keep_id")})
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
