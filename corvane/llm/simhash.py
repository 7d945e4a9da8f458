"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of
their 8 bytes, so they share at least 8 - d bytes at the same positions. The
index posts fingerprints under combinations of positions and their bytes, such
that every pair that shares the guaranteed minimum meets in some list. For a
pair that meets, the shared positional bytes are tallied; pairs that reach the
minimum are verified bit by bit.

Single bytes would give lists of a 256th of all fingerprints. Lists are
therefore kept by pairs of positions (2**16 values each), by a family of pairs
of which every set of 8 - d positions contains one. A list longer than
``LIST_LIMIT`` distinct fingerprints is split exactly: by every set of four
positions that contains its pair, and, if still longer, by four of the
remaining eight half-bytes as well, after which 16 free bits bound it.
Within a list no pairs are emitted; a search over the shrinking set of
fingerprints not yet reached yields a spanning forest. That search would be
quadratic in a list of unlike fingerprints, so a list longer than
``SEARCH_LIMIT`` is first grouped in memory by the further positions that its
pairs must share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, text_column
from .components import connected_components

SEED = 42
#: Longest list handled by one task, in distinct fingerprints (half a megabyte).
LIST_LIMIT = 1 << 16
#: Fingerprints that are searched one against the other without a further index.
SEARCH_LIMIT = 1 << 10


def shingle_hashes(text: bytes, shingle_words: int = 4) -> bytes:
    """XXH64 of every shingle, repeats included, 8 bytes each; a shorter text is one shingle, a blank one has none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return b""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle_words, len(words))
    starts = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)])


def fingerprint(hashes: bytes) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).view(">i8")[0])


def simhash(text: bytes, shingle_words: int = 4) -> int:
    return fingerprint(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = 4, text_name: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and blank texts have fingerprint zero."""
    rows = docs.select(docs["doc_id"], text_column(docs, text_name).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(x, shingle_words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def position_pairs(max_bits: int) -> list[tuple[int, int]]:
    """Pairs of positions such that every 8 - max_bits of the 8 positions contain one: positions
    fall into one group fewer than that minimum, as even as can be; two positions share a group."""
    groups = 8 - max_bits - 1
    if groups < 1:
        raise ValueError("at most 6 differing bits leave two bytes that must agree")
    parts = [range(8)[i::groups] for i in range(groups)]
    return [pair for part in parts for pair in combinations(part, 2)]


def _mask(positions, width: int = 8) -> int:
    x = sum(((1 << width) - 1) << (width * p) for p in positions)
    return x - (1 << 64) if x >> 63 else x


def _refined(mask: int, level: int, minimum: int) -> list[int]:
    """Masks that split the list of a mask without losing a pair."""
    unsigned = mask % (1 << 64)
    if level == 0:  # two bytes are fixed; pairs share at least ``minimum``
        held = [p for p in range(8) if unsigned >> (8 * p) & 255]
        rest = [p for p in range(8) if p not in held]
        return [_mask([*held, *more]) for more in combinations(rest, max(0, min(4, minimum) - 2))]
    free = [p for p in range(16) if not unsigned >> (4 * p) & 15]
    must = len(free) - (8 - minimum)  # at most 8 - minimum bits differ, each in one half-byte
    return [mask | _mask(more, 4) for more in combinations(free, must)]


def _forest(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Edges of a spanning forest over fingerprints of one list. Each fingerprint
    is compared with those not yet reached only."""
    edges, rest = [], values
    queue: list[np.uint64] = []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        if not len(rest):
            break
        near = _near(rest ^ at, max_bits)
        if near.any():
            found = rest[near]
            edges.append(np.stack([np.full(len(found), at), found], axis=1))
            queue += list(found)
            rest = rest[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _group_edges(values: np.ndarray, first: np.ndarray, mask: np.ndarray, max_bits: int) -> np.ndarray:
    """Edges that connect all pairs within ``max_bits`` bits in each group of ``values``; groups
    begin at ``first``, the fingerprints of one agree on the bytes of its ``mask``."""
    sizes = np.diff(np.r_[first, len(values)])
    out = [np.zeros((0, 2), np.uint64)]
    small, group = np.repeat(sizes <= 8, sizes), np.repeat(np.arange(len(first)), sizes)
    for step in range(1, 8):  # small groups: compare neighbours, all groups at once
        at = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(values) > step else np.zeros(0, int)
        if not len(at):
            break
        ok = at[_near(values[at] ^ values[at + step], max_bits)]
        out.append(np.stack([values[ok], values[ok + step]], axis=1))
    for k in np.flatnonzero(sizes > 8).tolist():
        held, own = values[first[k] : first[k] + sizes[k]], int(mask[k])
        free = [p for p in range(8) if not own >> (8 * p) & 255]
        more = min(2, 8 - max_bits - (8 - len(free)))  # positions that a pair shares beyond the mask
        if len(held) <= SEARCH_LIMIT or more < 1:
            out.append(_forest(held, max_bits))
            continue
        for positions in combinations(free, more):
            further = _mask(positions) % (1 << 64)
            key = held & np.uint64(further)
            order = np.argsort(key, kind="stable")
            begin = _starts(key[order])
            out.append(_group_edges(held[order], begin, np.full(len(begin), own | further, np.uint64), max_bits))
    return np.concatenate(out)


def _near(differ: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification."""
    shared = (differ[:, None].view(np.uint8) == 0).sum(axis=1) >= 8 - max_bits
    return shared & (np.bitwise_count(differ) <= max_bits)


def _list_edges(lists: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) from rows (mask, key, fp): each list is read by one task, in order."""
    ordered = lists.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def edges_of(rows: np.ndarray) -> pa.RecordBatch:
            mask, key, fp = rows
            first = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            found = _group_edges(fp.view(np.uint64), first, mask[first].view(np.uint64), max_bits).view(np.int64)
            a, b = found.min(axis=1), found.max(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])], axis=1)
            if not rows.shape[1]:
                continue
            last = np.searchsorted(np.flip(((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])).astype(np.int8)), 1)
            cut = rows.shape[1] - int(last)  # the last list may go on in the next batch
            if cut:
                yield edges_of(np.ascontiguousarray(rows[:, :cut]))
            held = rows[:, cut:]
        if held.shape[1]:
            yield edges_of(np.ascontiguousarray(held))

    return ordered.select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def _post(rows: DataFrame, masks) -> DataFrame:
    return rows.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def near_edges(distinct: DataFrame, max_bits: int = 4, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct`` (fp) within ``max_bits`` bits."""
    minimum = 8 - max_bits
    masks = [_mask(p) for p in position_pairs(max_bits)]
    lists = _post(distinct, F.array(*map(F.lit, masks)))
    out = None
    for level in range(3):
        lists = materialize(lists, f"simhash-lists-{level}")
        sizes = lists.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        long_lists = materialize(sizes.where(F.col("n") > list_limit).select("mask", "key"), "simhash-long")
        last = level == 2 or long_lists.isEmpty()
        edges = _list_edges(lists if last else lists.join(long_lists, ["mask", "key"], "left_anti"), max_bits)
        out = edges if out is None else out.unionByName(edges)
        if last:
            return out
        seen = [r[0] for r in long_lists.select("mask").distinct().collect()]  # at most 7, then at most 70
        finer = F.create_map(*[x for m in seen for x in (F.lit(m), F.array(*map(F.lit, _refined(m, level, minimum))))])
        kept = lists.join(long_lists, ["mask", "key"], "left_semi")
        lists = kept.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct().select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return out


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle_words: int = 4, text_name: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that links reach, links joining
    fingerprints at ``max_bits`` or fewer differing bits. Rows without words have
    fingerprint zero and link like any other. Equal fingerprints are one node,
    whatever their number. Null ids take the id of their component (null if it
    has no other); repeated rows are repeated in the result. Texts of any length
    are read whole, other columns are not.
    """
    marks = materialize(fingerprints(docs, shingle_words, text_name), "simhash-marks")
    nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = connected_components(near_edges(nodes.select("fp"), max_bits, list_limit))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    out = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(out, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
