"""Removal of repeated passages by Rabin-Karp hashes of word windows.

Every window of a fixed number of words has a polynomial hash of its words'
hashes. Windows are counted in Spark; of the occurrences of a repeated window
all but the earliest are removed, and overlapping ones merge into maximal
removal intervals.

Most windows occur once, and counting them all would move several times the
input. An exact filter goes first: each window is represented by the least
hash of its short word groups (its minimiser, the leftmost of equals). Equal
windows have equal minimisers at equal offsets, so a window whose minimiser
occurs at one place only cannot repeat, and only about a seventh of all places
are minimisers. Windows with a repeated minimiser are hashed and counted; no
window that repeats is lost. Documents whose words all equal an earlier
document's need no windows: they go as a whole.

Hashes are computed for many documents at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, text_column

GROUP_WORDS = 6
#: Names of the columns that the operator adds while it works.
DOC, HASH, NAMES = "__corvane_doc", "__corvane_hash", ("__corvane_doc", "__corvane_hash", "__corvane_starts", "__corvane_whole")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
B1, B2, B3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))  # odd constants of known mixers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * B3
    x = (x ^ (x >> np.uint64(29))) * B1
    return x ^ (x >> np.uint64(32))


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * B2)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, B1)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word hashes of a list of texts, and the document of each word."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = ~SPACE[data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.bounds = np.searchsorted(starts, first)  # words before each document
        self.counts = np.diff(self.bounds)
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        lengths = ends - starts
        places = np.flatnonzero(inside)
        within = places - np.repeat(starts, lengths)
        parts = BYTES[data[places]] * _powers(int(lengths.max()) + 1)[within]
        sums = np.add.reduceat(parts, np.cumsum(lengths) - lengths)
        self.hashes = _mixed(sums + lengths.astype(np.uint64) * B2)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window, and its document."""
        doc = np.repeat(np.arange(len(self.counts)), np.maximum(self.counts - size + 1, 0))
        before = np.cumsum(np.maximum(self.counts - size + 1, 0)) - np.maximum(self.counts - size + 1, 0)
        return np.arange(len(doc)) - before[doc] + self.bounds[:-1][doc], doc

    def rolled(self, size: int, base: np.uint64) -> np.ndarray:
        """Rabin-Karp hash of the ``size`` words from each word on, modulo 2**64."""
        n = max(0, len(self.hashes) - size + 1)
        out = self.hashes[:n].copy()
        for k in range(1, size):
            out = out * base + self.hashes[k : k + n]
        return out

    def minimisers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For the ``size`` words from each word on: the least group hash and its leftmost place."""
        value = _mixed(self.rolled(GROUP_WORDS, B2))
        place, span, want = np.arange(len(value)), 1, size - GROUP_WORDS + 1
        while span < want:
            step = min(span, want - span)
            if len(value) <= step:
                return value[:0], place[:0]
            left = value[:-step] <= value[step:]
            value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
            span += step
        return value, place


def _slices(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes with the index of the first; a longer text stands alone."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, texts[at:]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def document_marks(rows: DataFrame, window: int) -> DataFrame:
    """(doc, hash, n_words, w1, w2, minimisers) of rows (doc, hash, text); w1 and w2 hash all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for at, part in _slices(texts):
                words = Words(part)
                first, doc = words.windows(window)
                value, place = words.minimisers(window)
                value, place = value[first], place[first]
                new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])] if len(first) else np.zeros(0, bool)
                offsets = np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(part)))].astype(np.int32)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(words.hashes[a:b].tobytes()) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(words.counts.astype(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), _signed(value[new]))],
                    names=["doc", "hash", "n_words", "w1", "w2", "minimisers"],
                )

    return rows.mapInArrow(run, "doc long, hash long, n_words long, w1 long, w2 long, minimisers array<long>")


def candidate_windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc, hash, start, h1, h2, again) of rows (doc, hash, text, repeated): the windows whose
    minimiser is among the repeated ones; again: an earlier window of the document is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            repeated = batch.column(3)
            for at, part in _slices(texts):
                words = Words(part)
                first, doc = words.windows(window)
                value = words.minimisers(window)[0][first].view(np.int64)
                hit = np.zeros(len(first), bool)
                bounds = np.searchsorted(doc, np.arange(len(part) + 1))
                for k in range(len(part)):
                    a, b = bounds[k], bounds[k + 1]
                    hit[a:b] = np.isin(value[a:b], repeated[at + k].values.to_numpy())
                first, doc = first[hit], doc[hit]
                h1, h2 = words.rolled(window, B1)[first], (words.rolled(window, B3)[first] >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((first, h2, h1, doc))
                again = np.zeros(len(first), bool)
                o1, o2 = order[:-1], order[1:]
                again[o2[(doc[o1] == doc[o2]) & (h1[o1] == h1[o2]) & (h2[o1] == h2[o2])]] = True
                owner = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), pa.array((first - words.bounds[:-1][doc]).astype(np.int32)), _signed(h1), pa.array(h2.view(np.int32)), pa.array(again)],
                    names=["doc", "hash", "start", "h1", "h2", "again"],
                )

    return rows.mapInArrow(run, "doc long, hash long, start int, h1 long, h2 int, again boolean")


def removal_starts(docs: DataFrame, window: int = 20, text_name: str = "text") -> DataFrame:
    """(doc, hash, starts, whole): the removed windows of every document that has any; whole:
    all its words go, because an earlier document has the same words."""
    text = text_column(docs, text_name)
    rows = docs.select(_doc(docs).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marks = materialize(document_marks(rows, window).where(F.col("n_words") >= window), "passage-marks")
    whole = marks.groupBy("w1", "w2", "n_words").agg(F.min("doc").alias("first_doc"))
    copies = marks.select("doc", "hash", "w1", "w2", "n_words").join(whole, ["w1", "w2", "n_words"]).where("doc > first_doc").select("doc", "hash").distinct()
    copies = materialize(copies, "passage-copies")

    # Minimisers that occur at two places or more, in documents that are no copies.
    places = marks.select("doc", "hash", "minimisers").dropDuplicates(["doc", "hash"]).join(copies, ["doc", "hash"], "left_anti")
    places = places.select("doc", "hash", F.explode("minimisers").alias("v"))
    often = materialize(places.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v"), "passage-often", release=True)
    repeated = places.join(often, "v", "left_semi").groupBy("doc", "hash").agg(F.collect_set("v").alias("repeated"))
    repeated = materialize(repeated, "passage-candidates", release=True)

    found = rows.join(repeated.hint("shuffle_hash"), ["doc", "hash"]).select("doc", "hash", "text", "repeated")
    windows = materialize(candidate_windows(found, window), "passage-windows", release=True)
    once = windows.where("NOT again")
    earliest = once.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    earliest = materialize(earliest, "passage-earliest", release=True)  # joins of written tables split hot keys
    later = once.join(earliest, ["h1", "h2"]).where("doc > first_doc").select("doc", "hash", "start")
    gone = windows.where("again").select("doc", "hash", "start").unionByName(later)
    starts = gone.groupBy("doc", "hash").agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
    return starts.unionByName(copies.select("doc", "hash", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole")))


def _doc(docs: DataFrame):
    """A null doc_id comes before all others."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))


def intervals(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words covered by windows at ``starts``."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def substring_dedup(docs: DataFrame, window: int = 20, text_name: str = "text", respace: bool = False) -> DataFrame:
    """All columns of ``docs`` with repeated passages removed, plus n_words (before) and n_removed.

    A word goes if a window of ``window`` words that covers it has a word
    sequence that also starts earlier: in a document of smaller doc_id, or
    earlier in the same one. Kept words are joined by one space where something
    was removed, or everywhere with ``respace``; other texts stay as they are.
    Null and blank texts have no words. Rows with one doc_id count as one
    document, none of them earlier than the other; a null doc_id comes before
    all others; texts of any length are read whole. Columns of ``docs`` named
    n_words or n_removed give way to the result's; columns whose names begin with
    ``__corvane_`` must not exist.
    """
    docs = docs.drop("n_words", "n_removed")
    starts = materialize(removal_starts(docs, window, text_name), "passage-starts", release=True).toDF(*NAMES)
    base = docs.withColumn(text_name, text_column(docs, text_name))
    base = base.withColumns({DOC + "_k": _doc(base), HASH + "_k": F.xxhash64(text_name)})
    on = (base[DOC + "_k"] == starts[DOC]) & (base[HASH + "_k"] == starts[HASH])
    joined = base.join(starts.hint("shuffle_hash"), on, "left").select(*docs.columns, *NAMES[2:])
    names, at = docs.columns, docs.columns.index(text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            cuts = zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)
            for x, removed, whole in cuts:
                words = x.split()
                n_words.append(len(words))
                if whole:
                    kept = []
                elif removed:
                    kept, last = [], 0
                    for a, b in intervals(removed, window):
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                else:
                    kept = words
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept) if respace or len(kept) < len(words) else x)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    schema = docs.withColumn(text_name, F.lit("")).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(run, schema)
