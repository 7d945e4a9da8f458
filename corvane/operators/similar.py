"""Near copies by the Hamming distance of 64-bit content hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import components


def bands(bits: Column, max_bits: int) -> Column:
    """(band, key) for ``max_bits`` + 1 bands of a hash: two hashes that near agree on one of them."""
    n, out, at = max_bits + 1, [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        mask = ((1 << width) - 1) << at
        out.append(F.struct(F.lit(k).alias("band"), bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
        at += width
    return F.array(*out)


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect a list: each hash is compared with those not reached yet."""
    edges, queue, rest = [], [], values
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= max_bits
        edges += [(int(at), int(x)) for x in rest[near]]
        queue += list(rest[near])
        rest = rest[~near]
    return edges


def hash_edges(hashes: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) that connect all distinct ``hashes`` (bits) within ``max_bits`` bits. Lists are read in
    order by the tasks that hold them, pairs of a list are not emitted."""
    lists = hashes.select("bits", F.explode(bands(F.col("bits"), max_bits)).alias("t")).select("t.band", "t.key", "bits")
    lists = lists.repartition("band", "key").sortWithinPartitions("band", "key", "bits")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part])
            if not len(part):
                continue
            last = (part["band"] == part["band"].iloc[-1]) & (part["key"] == part["key"].iloc[-1])
            held = part[last]  # the last list may go on in the next batch
            yield edges_of(part[~last])
        if held is not None:
            yield edges_of(held)

    def edges_of(part: pd.DataFrame) -> pd.DataFrame:
        found = [e for _, own in part.groupby(["band", "key"])["bits"] if len(own) > 1 for e in _forest(own.to_numpy(), max_bits)]
        return pd.DataFrame(found or np.zeros((0, 2), np.int64), columns=["a", "b"])

    return lists.mapInPandas(run, "a long, b long")


def near_classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """(id, class_id) of rows (id, bits): the smallest id that links of at most ``max_bits`` differing bits
    reach. Equal hashes are one node; a null hash links to nothing."""
    nodes = written(rows.where("bits IS NOT NULL").groupBy("bits").agg(F.min("id").alias("least")), "hashes")
    roots = components(hash_edges(nodes.select("bits"), max_bits)).withColumnRenamed("node", "bits")
    nodes = written(nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "hash-roots")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("bits", "class_id")
    return rows.join(written(named, "hash-classes"), "bits", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
