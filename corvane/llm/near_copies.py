"""Near copies: SimHash links, verified and completed by Jaccard similarity of word shingles.

The byte-position index of ``simhash`` proposes links between fingerprints of
the same shingles; those whose sets have the similarity stay. At a Jaccard
similarity of 0.8 most pairs differ in more bits than byte positions can
guarantee to find, so what the index misses is completed exactly:

Two sets with a similarity of s or more share a member among the first
n - ceil(s * n) + 1 of each, in any order common to all sets. These members are
posted, so that every such pair meets in some list. The order is by hash, with
the members of the longest lists last, so that a passage common to many
documents is posted only by those that hold little else. Which members those
are decides the work only: any choice is an order.

Each document is verified against three of its lists where they share much,
first of all the one that is in most lists, and what links is joined. Then the pairs of a list that are
still in different components are verified, as far as sizes and places allow
the similarity: from the first member that two sets share on, they share no
more than what is left of either. Lists are aggregated and joined by member and
size class, never gathered in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialize, scratch_mark, sorted_buckets, text_column
from .components import connected_components
from .simhash import SEED, fingerprint, near_edges, shingle_hashes

#: Bytes kept of a member's hash.
MEMBER_BYTES = 5
#: Documents in a list beyond which its shingle may go last in the order, and how many shingles may (8 MB).
HOT_LIST, HOT_MEMBERS = 128, 1 << 20
#: Most times that lists are counted: members that go last make room for others of the same passage. It ends
#: with a round that adds a hundredth or less.
HOT_ROUNDS = 8
#: Differing bits up to which the SimHash index proposes links.
MAX_BITS = 4
#: Members (40 MB) that may always be on the way at once when pairs are verified.
LEAST_ROUND = 1 << 23


def members_of(hashes: bytes) -> np.ndarray:
    """The set of the shingles' hashes, sorted, each cut to ``MEMBER_BYTES``."""
    return np.unique(np.frombuffer(hashes, np.uint64) >> np.uint64(64 - 8 * MEMBER_BYTES)).view(np.int64)


def packed(members: np.ndarray) -> bytes:
    return members.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :MEMBER_BYTES].tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, MEMBER_BYTES)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :MEMBER_BYTES] = part
    return full.view("<i8").reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    """Members to post of a set of ``n``."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def shingle_sets(docs: DataFrame, shingle_words: int, text_name: str) -> DataFrame:
    """(doc_id, text_hash, sig, n, fp, members) of every row; sig is a 64-bit hash of the set, fp the fingerprint."""
    text = text_column(docs, text_name)
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, fp, sets = [], [], [], []
            for x in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(x, shingle_words)
                members = members_of(hashes)
                fp.append(fingerprint(hashes))
                sets.append(packed(members))
                n.append(len(members))
                sig.append(xxhash.xxh64_intdigest(sets[-1], SEED))
            columns = [pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "sig", "n", "fp", "members"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, sig long, n int, fp long, members binary")


def postings(sets: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """(h, sig, place) of the members that each set posts in the common order, places from 1."""
    late = sets.sparkSession.sparkContext.broadcast(hot)

    def posted(members: bytes) -> np.ndarray:
        x = unpacked(members)
        if len(late.value):
            x = x[np.argsort(np.isin(x, late.value, assume_unique=True), kind="stable")]
        return x[: prefix_length(len(x), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [posted(x) for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            h = np.concatenate([np.zeros(0, np.int64), *found])
            place = np.concatenate([np.zeros(0, np.int32), *[np.arange(1, n + 1, dtype=np.int32) for n in sizes]])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(place)], names=["h", "sig", "place"])

    return sets.select("sig", "members").mapInArrow(run, "h long, sig long, place int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, round_members: int | None = None) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is ``percent`` or more.

    The sets asked for lie in buckets, which joins read in place; the members of
    a travel to b once for each pair. All pairs are verified, in so many rounds that no
    more than about ``round_members`` (a quarter of all sets' members) are on
    the way at once. What a round moved is released before the next.
    """
    spark = sets.sparkSession
    asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    began = scratch_mark(spark)
    held = sets.select("sig", "n", "members").join(asked, "sig", "left_semi").dropDuplicates(["sig"])
    held = sorted_buckets(held, "near-copies-asked", "sig", release=True)
    ended = scratch_mark(spark)
    moved = pairs.join(held.select(F.col("sig").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
    most = round_members or max(LEAST_ROUND, (sets.agg(F.sum("n")).first()[0] or 0) // 4)
    rounds = max(1, -(-moved // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = None
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        both = some.join(held.select(F.col("sig").alias("a"), F.col("members").alias("x")), "a").join(held.select(F.col("sig").alias("b"), F.col("members").alias("y")), "b")
        found = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-copies-links", release=True)
        links = links.unionByName(found) if links is not None else found
    drop_scratch(spark, began, ended)
    return links


def _differ(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lo, hi) of the keys with more than one value."""
    return rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo < hi")


def simhash_links(sets: DataFrame, percent: int) -> DataFrame:
    """The links of the byte-position index that have the similarity: between a set and the first of
    its fingerprint, and between the first sets of near fingerprints."""
    held = sets.where("n > 0").select("sig", "fp")
    heads = materialize(held.groupBy("fp").agg(F.min("sig").alias("head")), "near-copies-heads")
    same = held.join(heads, "fp").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b")).distinct()
    near = near_edges(heads.select("fp"), MAX_BITS).distinct()
    for x in "ab":
        near = near.join(heads.withColumnsRenamed({"fp": x, "head": f"head_{x}"}), x)
    pairs = same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    return verified(materialize(pairs, "near-copies-pairs"), sets, percent)


def size_class(n: str, percent: int) -> Column:
    """Sets of the similarity are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col(n)).cast("int")


def link_edges(sets: DataFrame, percent: int, hot_list: int = HOT_LIST) -> DataFrame:
    """Edges (a, b) that connect all sets of a similarity of ``percent`` or more."""
    spark = sets.sparkSession
    proposed = simhash_links(sets, percent)
    hot = np.zeros(0, np.int64)
    for _ in range(HOT_ROUNDS):
        sizes = postings(sets, percent, hot).groupBy("h").agg(F.count(F.lit(1)).alias("size"))
        longest = materialize(sizes.where(F.col("size") > hot_list), "near-copies-hot", release=True).orderBy(F.desc("size"), "h").limit(HOT_MEMBERS).select("h").collect()
        found = np.union1d(hot, np.array([r[0] for r in longest], np.int64))[:HOT_MEMBERS]
        few, hot = len(found) - len(hot) <= len(hot) // 100, found
        if few:
            break
    about = materialize(sets.where("n > 0").select("sig", "n").distinct(), "near-copies-about")
    listed = scratch_mark(spark)
    lists = materialize(_differ(postings(sets, percent, hot), "h", "sig"), "near-copies-lists", release=True)
    shared = postings(sets, percent, hot).join(lists, "h").distinct().join(about, "sig")
    unlisted = scratch_mark(spark)
    shared = materialize(shared, "near-copies-shared", release=True)
    drop_scratch(spark, listed, unlisted)
    # A text that many others are copies of is in most of their lists: the best to compare them with.
    weight = materialize(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("lists")), "near-copies-weights")
    best = shared.join(weight, "sig").groupBy("h").agg(F.max(F.struct("lists", "sig"))["sig"].alias("best"))
    best = materialize(best, "near-copies-best")

    def with_roots(rows: DataFrame, edges: DataFrame) -> DataFrame:
        roots = connected_components(edges).withColumnRenamed("node", "sig")
        return rows.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))

    similar_size = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    stars = shared.join(best, "h").select(F.explode(F.array("best", "lo", "hi")).alias("p"), F.col("sig").alias("q"), "n").where("p <> q")
    stars = stars.groupBy("p", "q", "n").agg(F.count(F.lit(1)).alias("shared"))
    # most links show here already; what this leaves out meets in the last round
    stars = stars.where(f"6 * shared >= n - ({percent} * n + 99) div 100 + 1")
    stars = stars.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    first = verified(materialize(stars, "near-copies-pairs", release=True), sets, percent).unionByName(proposed)
    rows = materialize(with_roots(shared.select("h", "sig", "place", "n"), first), "near-copies-rows", release=True)
    drop_scratch(spark, unlisted, unlisted + 1)
    rowed = scratch_mark(spark)
    split = materialize(_differ(rows, "h", "root").select("h"), "near-copies-split", release=True)
    parts = rows.join(split, "h", "left_semi").withColumn("class", size_class("n", percent))
    parts = materialize(parts, "near-copies-parts", release=True)
    drop_scratch(spark, rowed - 1, rowed)
    a = parts.select("h", "class", *[F.col(c).alias(f"{c}_a") for c in ("sig", "root", "n", "place")])
    b = parts.select("h", F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("sig", "root", "n", "place")])
    may_reach = F.expr(f"(100 + {percent}) * (1 + least(n_a - place_a, n_b - place_b)) >= {percent} * (n_a + n_b)")
    cross = a.join(b, ["h", "class"]).where("root_a < root_b").where(similar_size).where(may_reach)
    cross = cross.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct()
    second = verified(materialize(cross, "near-copies-pairs", release=True), sets, percent)
    return first.unionByName(second)


def near_copies(docs: DataFrame, percent: int = 80, shingle_words: int = 5, text_name: str = "text", hot_list: int = HOT_LIST) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of every row; root tells the components apart.

    component_id is the smallest doc_id that links reach, links joining texts
    whose sets of shingles have a Jaccard similarity of ``percent`` or more.
    Texts with equal sets are one node, those without words too. Null ids take
    the id of their component (null if it has no other). text_hash is the XXH64
    of the text, null as empty. Repeated rows are repeated, texts of any length
    are read whole, other columns are not read.
    """
    sets = materialize(shingle_sets(docs, shingle_words, text_name), "near-copies-sets")
    nodes = sets.groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(link_edges(sets, percent, hot_list)).withColumnRenamed("node", "sig")
    nodes = materialize(nodes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "near-copies-nodes")
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = materialize(nodes.join(least, "root").select("sig", "root", "component_id"), "near-copies-found")
    return sets.select("doc_id", "text_hash", "sig").join(found, "sig").select("doc_id", "text_hash", "root", "component_id")


def first_of_each(docs: DataFrame, percent: int = 80, shingle_words: int = 5, text_name: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``near_copies``: that of the smallest doc_id (null
    last), of rows with one id the text of the smallest hash, of equal rows any one."""
    spark = docs.sparkSession
    began = scratch_mark(spark)
    found = materialize(near_copies(docs, percent, shingle_words, text_name), "near-copies-marks")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__corvane_id"), F.col("k.text_hash").alias("__corvane_hash"))
    repeated = not found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    ended = scratch_mark(spark)
    kept = materialize(kept, "near-copies-kept", release=True)
    drop_scratch(spark, began, ended)
    base = docs.withColumn("__corvane_row_hash", F.xxhash64(text_column(docs, text_name)))
    on = base["doc_id"].eqNullSafe(kept["__corvane_id"]) & (base["__corvane_row_hash"] == kept["__corvane_hash"])
    rows = base.join(kept.hint("shuffle_hash"), on, "left_semi")
    if repeated:  # equal rows share their key
        rows = rows.dropDuplicates(["doc_id", "__corvane_row_hash"])
    return rows.select(*docs.columns)
