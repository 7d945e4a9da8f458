"""Ranking operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Queries scored in one pass over the rows.
QUERY_BLOCK = 256


def top_k(rows: DataFrame, queries: DataFrame, k: int, keep: list[str] | None = None) -> DataFrame:
    """The k nearest rows (fp, embedding) of each query (query_id, vector) by cosine: query_id, fp, rank
    and score rounded to six digits; ties by fp.

    Queries are read in blocks of ``QUERY_BLOCK``; each Arrow batch of rows is
    scored against a block by one matrix product and keeps k rows a query, and
    only those meet. Rows without a vector, or of another dimension, are no hits.
    """

    def nearest(part: pd.DataFrame, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ties = np.broadcast_to(part["fp"].rank(method="first").to_numpy()[:, None], score.shape)
        order = np.lexsort((ties, -score), axis=0)[:k]
        return order.ravel(order="F"), np.repeat(np.arange(score.shape[1]), len(order))

    found = _scored(rows, queries, keep or [], nearest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fp"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def above(rows: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, fp, score) of all rows that reach the threshold."""
    return _scored(rows, queries, [], lambda part, score: np.nonzero(score >= threshold))


def best_passages(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item, best_index, similarity): the best passage of rows (item, idx, embedding) for each
    query, the first of equals. A batch passes on one passage of each item it holds."""

    def best(part: pd.DataFrame, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((part["idx"].to_numpy(), part["item"].to_numpy()))
        first = np.flatnonzero(np.r_[True, np.diff(part["item"].to_numpy()[order]) != 0])
        at, of = [], []
        for q in range(score.shape[1]):
            ranked = order[np.lexsort((part["idx"].to_numpy()[order], -score[order, q], part["item"].to_numpy()[order]))]
            at.append(ranked[first])
            of.append(np.full(len(first), q))
        return np.concatenate(at), np.concatenate(of)

    found = _scored(rows.withColumn("fp", F.lit("")), queries, ["item", "idx"], best)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score")))
    return found.groupBy("query_id", "item").agg(F.min_by("idx", F.struct((-clamped).alias("s"), "idx")).alias("best_index"), F.max(clamped).alias("similarity"))


def _scored(rows: DataFrame, queries: DataFrame, keep: list[str], choose: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(fp, keep..., query_id, score) of the pairs that ``choose`` names by row and query, batch by batch
    and block of queries by block; cosine rounded to six digits. Rows of another dimension are left out."""
    found = None
    for ids, block in _blocks(queries):
        columns = rows.select("fp", *keep, F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == block.shape[1])

        def run(parts: Iterator[pd.DataFrame], ids=ids, block=block) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                score = np.round(_unit(np.stack(part["embedding"].to_numpy())) @ block.T, 6) + 0.0
                at, of = choose(part, score)
                out = part.iloc[at][["fp", *keep]].reset_index(drop=True)
                out["query_id"], out["score"] = ids[of], score[at, of]
                yield out

        schema = ", ".join([f"{c} {columns.schema[c].dataType.simpleString()}" for c in ("fp", *keep)]) + ", query_id long, score double"
        part = columns.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select("fp", *keep, F.lit(0).cast("long").alias("query_id"), F.lit(0.0).alias("score")).limit(0)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the queries, ``QUERY_BLOCK`` at a time and in order of their ids; the driver holds one block."""
    after = None
    while True:
        rest = queries if after is None else queries.where(F.col("query_id") > after)
        block = rest.orderBy("query_id").limit(QUERY_BLOCK).collect()
        if not block:
            return
        after = block[-1]["query_id"]
        yield np.array([r["query_id"] for r in block]), _unit(np.array([r["vector"] for r in block], float))


def bm25(docs: DataFrame, asked: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query (item_id, word).

    One pass over the corpus yields the asked words of each document beside its
    length, as one row a document; the sums over all lengths come out of the same
    rows. What is shuffled are hits, not the corpus. ``asked`` is a set of queries, so
    its distinct words are looked up in a map that the tasks hold.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"))
    vocabulary = asked.select("word").distinct()
    texts = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("dl"), "w")
    rows = written(texts.select("doc_id", "dl", F.explode_outer("w").alias("word")).join(vocabulary.withColumn("asked", F.lit(1)), "word", "left").groupBy("doc_id", "dl", F.when(F.col("asked") == 1, F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("f")), "bm25-hits")
    lengths = rows.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl")).head()
    tf = rows.where("word IS NOT NULL")
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("d"))
    idf = F.log(1 + (stats["n"] - F.col("d") + 0.5) / (F.col("d") + 0.5))
    gain = F.col("f") * (k1 + 1) / (F.col("f") + k1 * ((1 - b) + b * F.col("dl") / (stats["avgdl"] or 1.0)))
    scored = asked.join(tf, "word").join(df, "word").groupBy("item_id", "doc_id").agg(F.round(F.sum(idf * gain), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = 20, weights: tuple[float, float] = (1.0, 1.0), base: int = 60) -> DataFrame:
    """(query_id, id, dense_rank, lexical_rank, rrf, rank): both ranked lists (query_id, id, rank) of each
    query fused by weighted reciprocal ranks, the k best, ties by id."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    w = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    part = lambda c, weight: F.coalesce(F.lit(weight) / (base + F.col(c)), F.lit(0.0))
    both = d.join(w, ["query_id", "id"], "full").withColumn("rrf", F.round(part("dense_rank", weights[0]) + part("lexical_rank", weights[1]), 8))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)
