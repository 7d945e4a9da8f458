"""Line deduplication with levelled sorted runs of line hashes.

Lines are keyed by a 128-bit hash of their trimmed, lower-cased bytes. Batches
of documents arrive one after the other. The store keeps two kinds of sorted
runs: settled runs hold keys already found in enough documents, pending runs
hold keys with their document counts. A batch's keys merge-anti-join the
settled runs, so common lines are not counted again, and the rest becomes a
run of its own at level 0. When a level is full its runs are merged into one
of the next level; keys that reach the limit move to a settled run.

A run is a table in sorted buckets by key. A batch's counts come out of their
aggregation dealt the same way, so that the anti-join is a merge join that
moves neither side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, sorted_buckets, text_column

KEY = ["h1", "h2"]
#: Names of the columns that the operator adds while it works.
ROW_ID, ROW_HASH, CUT = "__corvane_id", "__corvane_text_hash", "__corvane_cut"


class LineRuns:
    """Levelled runs of (h1, h2, n_docs) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 2):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """``rows``, dealt by key, without the keys of the settled runs."""
        for run in self.settled:
            rows = rows.join(run.hint("merge"), KEY, "left_anti")
        return rows

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row (h1, h2) for each document and key."""
        counts = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"))
        self.levels[0].append(sorted_buckets(self.unsettled(counts), "line-run", *KEY))
        level = 0
        while len(self.levels[level]) >= self.fan:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = sorted_buckets(self._merge(self.levels[level]), "line-merge", *KEY)
        reached = merged.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        self.settled.append(sorted_buckets(reached, "line-settled", *KEY))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level] = []
        self.levels[level + 1].append(merged.where(F.col("n_docs") < self.min_docs))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Counts of unsettled keys over several runs, by merge joins."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.join(b.withColumnRenamed("n_docs", "more").hint("merge"), KEY, "full")
            return joined.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

        return reduce(both, map(self.unsettled, runs))

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches, each once: no run holds
        a key that another has settled before."""
        pending = [run for level in self.levels for run in level]
        parts = list(self.settled)
        if pending:
            parts.append(self._merge(pending).where(F.col("n_docs") >= self.min_docs).select(*KEY))
        return reduce(DataFrame.unionByName, parts)


def line_keys(docs: DataFrame, batches: int, text_name: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, row id, text hash, positions, batch) for every distinct key of every row."""
    text = text_column(docs, text_name)
    rows = docs.select(docs["doc_id"].alias(ROW_ID), text.alias("text"), F.xxhash64(text).alias(ROW_HASH))
    kind = rows.schema[ROW_ID].dataType

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, batch_no = xxhash.xxh3_128_digest, TaskContext.get().partitionId() % batches
        for batch in batch_iter:
            hashes, owner, places = [], [], []
            for row, x in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                seen: dict[bytes, list[int]] = {}
                for i, line in enumerate(x.split(b"\n")):
                    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
                    if key and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars):
                        seen.setdefault(digest(key), []).append(i)
                hashes += seen.keys()
                places += seen.values()
                owner += [row] * len(seen)
            h = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pa.py_buffer(b"".join(hashes))])
            take = pa.array(owner, pa.int64())
            evens = pa.array(range(0, 2 * len(hashes), 2), pa.int64())
            odds = pa.array(range(1, 2 * len(hashes), 2), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [h.take(evens), h.take(odds), batch.column(0).take(take), batch.column(2).take(take), pa.array(places, pa.list_(pa.int32())), pa.array([batch_no] * len(hashes), pa.int32())],
                names=["h1", "h2", ROW_ID, ROW_HASH, "positions", "batch"],
            )

    return rows.mapInArrow(run, f"h1 long, h2 long, {ROW_ID} {kind.simpleString()}, {ROW_HASH} long, positions array<int>, batch int")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text_name: str = "text") -> DataFrame:
    """All columns of ``docs`` with common lines removed from the text, plus
    n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, with A-Z in lower
    case. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` rows lose all their lines in every row. A null or empty text is
    one empty line and stays as it is (null becomes empty). Rows are told apart
    by doc_id and text: repeated rows each count as a document and lose the same
    lines; a null doc_id is an id like any other; texts of any length are read
    whole. Columns of ``docs`` named n_lines or n_dropped give way to the result's;
    columns whose names begin with ``__corvane_`` must not exist.
    """
    spark, docs = docs.sparkSession, docs.drop("n_lines", "n_dropped")
    keys = materialize(line_keys(docs, batches, text_name, min_chars), "line-keys", "batch")
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch).select(*KEY))
    frequent = materialize(runs.frequent(), "line-frequent")  # a join of written tables splits hot keys
    cuts = (
        keys.join(frequent, KEY, "left_semi")
        .groupBy(ROW_ID, ROW_HASH)
        .agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias(CUT))
        .withColumnsRenamed({ROW_ID: ROW_ID + "_r", ROW_HASH: ROW_HASH + "_r"})
    )
    # The cuts are the smaller side by far; hashing them spares sorting the texts.
    base = docs.withColumn(text_name, text_column(docs, text_name)).withColumn(ROW_HASH, F.xxhash64(text_name))
    on = base["doc_id"].eqNullSafe(cuts[ROW_ID + "_r"]) & (base[ROW_HASH] == cuts[ROW_HASH + "_r"])
    joined = base.join(cuts, on, "left").drop(ROW_HASH, ROW_ID + "_r", ROW_HASH + "_r")
    at, names = docs.columns.index(text_name), docs.columns

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts, n_lines, n_dropped = [], [], []
            for x, cut in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                n_lines.append(x.count(b"\n") + 1)
                n_dropped.append(len(cut or ()))
                if cut:
                    gone = set(cut)
                    x = b"\n".join([line for i, line in enumerate(x.split(b"\n")) if i not in gone])
                texts.append(x)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = docs.withColumn(text_name, F.lit("")).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return joined.select(*names, CUT).mapInArrow(run, schema)
