"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are whole numbers up to the capacity, so the packing is decided on
their counts, one number for each length, whatever the number of documents.
Longest first, the gap that a length leaves is looked up among the single
lengths, then among the indexed sums of pairs, then of triples; a combination
that fills the gap exactly is used as often as the counts of its lengths
allow. What is left is packed best-fit. The plan is a list of patterns with
multiplicities; a piece finds its place by its rank among the pieces of its
length, so pieces are never gathered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._shared import materialize, text_column
from .pieces import in_slices

CAPACITY = 2048
#: Pieces ranked by one task.
RANK_ROWS = 50_000


class Plan:
    """Patterns chosen for counts of lengths; ``segments`` are rows (length, first rank,
    number of ranks, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 <= length <= capacity:
                raise ValueError(f"length {length} is beyond the capacity")
            self.left[length] = n
        self.rank, self.sequences = [0] * (capacity + 1), 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        if self.left[0]:
            self._use([0])
        for length in range(capacity, 0, -1):
            while self.left[length]:
                pattern = self._exact(length)
                if pattern is None:
                    break
                self._use(pattern)
        for length in range(capacity, 0, -1):
            while self.left[length]:
                self._use(self._best_fit(length))

    def _times(self, pattern: list[int]) -> int:
        """How often the pattern fits into what is left."""
        return min(self.left[x] // n for x, n in Counter(pattern).items())

    def _use(self, pattern: list[int]) -> None:
        times, offset = self._times(pattern), 0
        for x in pattern:
            self.segments.append((x, self.rank[x], times, self.sequences, offset))
            self.rank[x] += times
            self.left[x] -= times
            offset += x
        self.sequences += times

    def _exact(self, length: int) -> list[int] | None:
        """A combination with one, two or three other lengths that fills the capacity."""
        gap = self.capacity - length
        if gap == 0:
            return [length]
        there = [x for x in range(min(gap, self.capacity), 0, -1) if self.left[x]]
        single = 0
        for x in there:
            single |= 1 << x
        if single >> gap & 1 and self._times([length, gap]):
            return [length, gap]
        if pair := self._pair(gap, there, single, [length]):
            return pair
        pairs = 0  # sums of two lengths
        for x in there:
            pairs |= single << x
        for x in there:
            if x < gap and pairs >> (gap - x) & 1 and (triple := self._pair(gap - x, there, single, [length, x])):
                return triple
        return None

    def _pair(self, gap: int, there: list[int], single: int, held: list[int]) -> list[int] | None:
        for x in there:
            if 2 * x < gap:
                return None
            if x < gap and single >> (gap - x) & 1 and self._times(pattern := [*held, x, gap - x]):
                return pattern
        return None

    def _best_fit(self, length: int) -> list[int]:
        pattern, gap, used = [length], self.capacity - length, Counter([length])
        x = min(gap, length)
        while x > 0 and gap:
            if x <= gap and self.left[x] > used[x]:
                pattern.append(x)
                used[x] += 1
                gap -= x
                x = min(x, gap)
            else:
                x -= 1
        return pattern


def place(pieces: DataFrame, plan_counts: dict[int, int], order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length``) plus sequence_id and offset. ``order`` names columns
    that tell pieces apart, so that ranks are the same when a task runs again."""
    plan = Plan(plan_counts, capacity)
    salts = F.array(*[F.lit(-(-plan_counts.get(n, 0) // RANK_ROWS) or 1) for n in range(capacity + 1)])
    salted = pieces.withColumn("__corvane_salt", F.pmod(F.xxhash64(*order), F.get(salts, F.col("length"))).cast("int"))
    key = ["length", "__corvane_salt"]
    sizes = salted.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__corvane_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__corvane_base"))
    ranked = salted.withColumn("__corvane_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).join(bases, key)
    ranked = ranked.withColumn("__corvane_rank", (F.col("__corvane_rank") + F.col("__corvane_base")).cast("long"))

    # At most a few patterns for each length: bounded by the capacity, not by the data.
    table = np.array(sorted(plan.segments) or [(0, 0, 0, 0, 0)], np.int64)
    keys = table[:, 0] << 44 | table[:, 1]
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (len(names), len(names) + 1))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            columns = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, "sequence_id", "offset"])

    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.select(*names, F.col("length").alias("__corvane_length"), "__corvane_rank").mapInArrow(run, schema)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY, with_ids: bool = False, text_name: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text's tokens and the end id, cut
    only where they exceed the capacity."""
    rows = docs.select(docs["doc_id"], text_column(docs, text_name).alias("text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.model(tokenizer)
        for batch in batches:
            owner, piece, parts = [], [], []
            encoded = (ids for part in in_slices(batch.column(1).cast(pa.binary()).to_pylist()) for ids in model.encode_all(part))
            for row, ids in enumerate(encoded):
                ids += tail
                for k, a in enumerate(range(0, max(1, len(ids)), 4 * capacity)):
                    owner.append(row)
                    piece.append(k)
                    parts.append(ids[a : a + 4 * capacity])
            number = np.array(piece, np.int32)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY, with_ids: bool = False, text_name: str = "text") -> DataFrame:
    """Pieces of ``token_pieces`` plus sequence_id and offset.

    Null and empty texts are one piece that holds the end id. Repeated rows
    have pieces of their own; a null doc_id is kept. Very long texts are cut into
    pieces of ``capacity`` tokens. Sequences are gapless from offset 0 and hold at
    most ``capacity`` tokens. Other columns are not read.
    """
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, with_ids, text_name), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    return place(pieces, counts, ["doc_id", "piece", "ids_crc32"], capacity)
