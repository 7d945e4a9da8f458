"""Token-id files with fixed-width bit packing.

A shard image holds consecutive documents. Every id takes the least number of
bits that the vocabulary needs, most significant bit first. Ids are packed in
blocks of a fixed count, each starting at a byte; the image stores the byte
offset of every block, so that a range of ids is read by unpacking only the
blocks it touches, with numpy and without loops over ids.

Image: magic, bits, ids a block (u4 each), number of ids and documents (u8
each), document ids (i8) and their validity (u1), the first id of each
document and the end (u8), block offsets and the end (u8), payload.

Executors cannot open the cluster's file system, so Spark's own writer stores
the images, one row each, in a Parquet folder; a lost executor's partial
output is dropped by its commit protocol.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import text_column
from .pieces import Memory, encode_texts, in_slices

MAGIC = b"CVTOKENS"
HEAD = struct.Struct("<8sIIQQ")
#: Ids in a block and, about, in a shard.
BLOCK_IDS, SHARD_IDS = 4096, 1 << 21


def id_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of ``bits`` bits each, filled up with zeros to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    table = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(table.reshape(-1)).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    table = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - bits :] = table
    return np.packbits(full, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def shard_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    return b"".join([
        HEAD.pack(MAGIC, bits, block_ids, len(ids), len(doc_ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes(),
        np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes(),
        *blocks,
    ])


class Shard:
    """Random access to an image."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block_ids, self.n_ids, n = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        ids = np.frombuffer(image, "<i8", n, at)
        valid = np.frombuffer(image, "u1", n, at := at + 8 * n)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid, strict=True)]
        self.starts = np.frombuffer(image, "<u8", n + 1, at := at + n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block_ids)
        self._offsets = np.frombuffer(image, "<u8", n_blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self._payload = memoryview(image)[at + 8 * (n_blocks + 1) :]

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first..end-1, from the blocks that hold them."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, (end - 1) // self.block_ids
        parts = [unpack(self._payload[self._offsets[k] : self._offsets[k + 1]], min(self.block_ids, self.n_ids - k * self.block_ids), self.bits) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class LibraryEncoder:
    """The tokenizers library with a memory of short pieces.

    A text is cut where the file's own pattern always cuts. Byte-level files cut
    before a word with the space in front of it, and around other white space;
    texts with special tokens or white space beyond ASCII are encoded as a
    whole. Files with word ends drop white space, so pieces are what stands
    between it; as they also lower the case, A-Z is lowered first where no
    special token can be meant.
    """

    WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
    WORDS, BYTES, JOINED = 600_000, 64, 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._by_word = bool(json.loads(self.library.to_str())["model"].get("end_of_word_suffix"))
        self._whole = re.compile(b"|".join([*(re.escape(x.encode()) for x in added), self.WIDE_SPACE.pattern]))
        mark = "\u0120"  # stands for the space in front of a word
        self._opens = np.array([(self.library.id_to_token(i) or "").startswith(mark) for i in range(self.vocab_size)])
        self._memory = Memory(self.WORDS, self.BYTES)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece. Pieces of byte-level files that begin with a space are encoded
        many at once, as one text, and told apart by the tokens that begin with a space."""
        out: list[bytes] = [b""] * len(pieces)
        spaced = [] if self._by_word else [i for i, p in enumerate(pieces) if p[:1] == b" " and len(p) > 1 and not self._whole.search(p)]
        plain = set(range(len(pieces))).difference(spaced)
        parts = [spaced[k : k + self.JOINED] for k in range(0, len(spaced), self.JOINED)]
        texts = [b"".join([pieces[i] for i in part]).decode("utf-8") for part in parts]
        for part, found in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            opens = (4 * np.flatnonzero(self._opens[ids])).tolist()
            if len(opens) != len(part) or opens[0]:
                plain.update(part)
                continue
            data = ids.tobytes()
            for i, a, b in zip(part, opens, [*opens[1:], len(data)], strict=True):
                out[i] = data[a:b]
        rest = sorted(plain)
        for i, found in zip(rest, self.library.encode_batch_fast([pieces[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def encode_all(self, texts: list[bytes], end: int | None = None) -> list[bytes]:
        """Ids of each text as little-endian u4, ``end`` appended."""
        tail = b"" if end is None else struct.pack("<I", end)
        if self._by_word:
            cut, whole = [x if b"<" in x else x.lower() for x in texts], []
        else:
            whole = [i for i, x in enumerate(texts) if self._whole.search(x)]
            cut = list(texts)
            for i in whole:
                cut[i] = b""
        out = encode_texts(cut, not self._by_word, lambda pieces: self._memory.look_up(pieces, self._encode_pieces))
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i].decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        return [x + tail for x in out] if tail else out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 0, id_column: str = "doc_id", text_column_name: str = "text") -> None:
    """Encode every text and write shard images to ``out`` in ascending id order.

    Texts are dealt by range of the id, so each partition holds consecutive
    documents; (partition, shard) orders the images. Null ids come first, rows
    with one id are ordered by text, null and empty texts hold only the end id.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_column(docs, text_column_name).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits = id_bits(max(enc.vocab_size, (end_id or 0) + 1))
        shard, names, counts, data, size = 0, [], [], [], 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([shard_image(names, counts, ids, bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["partition", "shard", "n_ids", "image"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in in_slices(batch.column(1).cast(pa.binary()).to_pylist()):
                for x in enc.encode_all(texts, end_id):
                    names.append(next(ids))
                    counts.append(len(x) // 4)
                    data.append(x)
                    size += len(x) // 4
                    if size >= SHARD_IDS:
                        yield image()
                        shard, names, counts, data, size = shard + 1, [], [], [], 0
        if names:
            yield image()

    dealt.mapInArrow(run, "partition int, shard int, n_ids long, image binary").write.mode("overwrite").parquet(out)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(partition, shard, base): ids before each image. Prefix sums run within each
    partition; only the partitions' totals, one row each, are summed in one task."""
    sizes = spark.read.parquet(path).select("partition", "shard", "n_ids")
    totals = sizes.groupBy("partition").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("partition", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.select("partition", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("within"))
    return local.join(totals, "partition").select("partition", "shard", (F.col("before") + F.col("within")).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files."""
    return _with_starts(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return _with_starts(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _with_starts(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, image in zip(*(batch.column(c).to_pylist() for c in ("partition", "shard", "image")), strict=True):
                shard = Shard(image)
                n = len(shard.doc_ids)
                ids = shard.ids(0, shard.n_ids)
                values = [value(ids[a:b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1], pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(values, kind)],
                    names=["partition", "shard", "doc_id", "first", "n_tokens", name],
                )

    found = spark.read.parquet(path).select("partition", "shard", "image").mapInArrow(run, f"partition int, shard int, doc_id long, first long, n_tokens long, {column}")
    joined = found.join(shard_starts(spark, path), ["partition", "shard"])
    return joined.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", name)
