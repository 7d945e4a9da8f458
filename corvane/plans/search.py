"""Vector and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.limits import request_limits
from ..operators.search import above, best_passages, bm25, hybrid, top_k
from ..sources import views
from .base import query

DIMS = (64, 256, 384, 512, 768)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), "vec_id").alias("fp"), "vec_id", "label", (F.col("label") % 5).alias("encoder_id"), "embedding")


def asked_vectors(rows: DataFrame) -> DataFrame:
    """The query set of vector searches: every row whose id is divisible by fifty."""
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))


SCORES = """
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, 'v' || vec_id AS fp, vec_id, label, label % 5 AS encoder_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q)
"""
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fp) AS rank"


@query(SCORES + f"SELECT query_id, fp, score, {TOP} FROM s QUALIFY rank <= 10")
def rnk2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return top_k(rows, asked_vectors(rows), 10)


@query(SCORES + f"SELECT query_id, fp, score, {TOP} FROM s WHERE encoder_id IN (0, 1) QUALIFY rank <= 10")
def flt14_vector_topk_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed encoders are chosen before scoring, so they reach the scan."""
    rows = stored(spark, sf_dir)
    return top_k(rows.where(F.col("encoder_id").isin(0, 1)), asked_vectors(rows), 10)


@query(SCORES + "SELECT query_id, fp, score FROM s WHERE score >= 0.4")
def flt15_vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return above(rows, asked_vectors(rows), 0.4)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:16], lambda x: x * x))), 6) AS cut_norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:16], lambda x: x * x))), 6) AS first, 16 AS dim FROM embeddings")
def mth3_truncated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).withColumn("cut", V.fit(F.col("embedding"), 16))
    return rows.select("vec_id", F.round(V.norm(F.slice("embedding", 1, 16)), 6).alias("cut_norm"), F.round(F.get("cut", F.lit(0)), 6).alias("first"), F.size("cut").alias("dim"))


@query("""
    WITH m AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: 0.6 * CAST(a.embedding[i] AS DOUBLE) + 0.4 * CAST(b.embedding[i] AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM m
""")
def mth5_late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stored(spark, sf_dir).select("vec_id", F.col("embedding").alias("a"))
    b = stored(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(F.get(V.fuse(F.col("a"), F.col("b")), F.lit(0)), 6).alias("first"))


@query("SELECT len(embedding) AS dim, count(*) AS vectors, count(DISTINCT label) AS labels FROM embeddings GROUP BY 1")
def vec1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("label").alias("labels"))


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER)) AS i FROM embeddings)
    SELECT vec_id, array_to_string(i, ' ') AS bytes, list_sum(list_transform(x, lambda y: CASE WHEN y > 0 THEN 1 ELSE 0 END))::BIGINT AS ones,
           abs(list_cosine_similarity(x, list_transform(i, lambda y: y / 127.0)) - 1) <= 0.05 AS near FROM v
""")
def vec2_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, the one-bit code's ones, and whether the vector read back points the same way."""
    q = V.quantise(F.col("embedding"))
    near = F.abs(V.cosine(F.col("embedding"), V.dequantise(q)) - 1) <= 0.05
    return stored(spark, sf_dir).select("vec_id", F.array_join(F.transform(q, lambda x: x.cast("string")), " ").alias("bytes"), F.bit_count(V.sign_hash(F.col("embedding"))).cast("long").alias("ones"), near.alias("near"))


STORE = """
    sent AS (SELECT 'f' || vec_id AS fp, label AS encoder_id, 0 AS seq, embedding AS v, vec_id FROM embeddings
             UNION ALL SELECT 'f' || vec_id, label + 100, 1, CASE WHEN vec_id % 5 = 0 THEN embedding[1:8] WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: CAST('nan' AS FLOAT)) ELSE embedding END, vec_id FROM embeddings WHERE vec_id % 3 = 0),
    valid AS (SELECT * FROM sent WHERE len(v) IN (64, 256, 384, 512, 768) AND NOT list_aggregate(list_transform(v, lambda x: isnan(x)), 'bool_or')),
    latest AS (SELECT *, row_number() OVER (PARTITION BY fp, len(v) ORDER BY seq DESC) AS k FROM valid)
"""


def sent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), "vec_id").alias("fp"), F.col("label").alias("encoder_id"), F.lit(0).alias("seq"), F.col("embedding").alias("v"), "vec_id")
    torn = F.when(F.col("vec_id") % 5 == 0, F.slice("v", 1, 8)).when(F.col("vec_id") % 7 == 0, F.transform("v", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("v"))
    again = e.where("vec_id % 3 = 0").withColumns({"encoder_id": F.col("encoder_id") + 100, "seq": F.lit(1), "v": torn})
    return e.unionByName(again)


def stored_vectors(sent: DataFrame) -> DataFrame:
    """The last valid vector of each fingerprint and dimension: allowed dimensions, no NaN."""
    valid = sent.where(F.size("v").isin(*DIMS) & ~F.exists("v", lambda x: F.isnan(x)))
    last = F.max_by(F.struct("encoder_id", "vec_id"), "seq").alias("t")
    return valid.groupBy("fp", F.size("v").alias("dim")).agg(last).select("fp", "dim", "t.encoder_id", "t.vec_id")


@query(f"WITH {STORE} SELECT fp, len(v) AS dim, encoder_id FROM latest WHERE k = 1 AND vec_id % 10 <> 7")
def snk1_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts by fingerprint and dimension, then deletions by fingerprint in all dimensions."""
    store = stored_vectors(sent_vectors(spark, sf_dir))
    gone = views.table(spark, sf_dir, "embeddings").where("vec_id % 10 = 7").select(F.concat(F.lit("f"), "vec_id").alias("fp"))
    return store.join(gone, "fp", "left_anti").select("fp", "dim", "encoder_id")


@query(f"WITH {STORE} SELECT (SELECT count(*) FROM sent) AS sent, (SELECT count(*) FROM valid) AS accepted, (SELECT count(*) FROM latest WHERE k = 1 AND vec_id % 10 = 7) AS deleted")
def snk2_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch and a deletion report: vectors sent, accepted and deleted."""
    sent = sent_vectors(spark, sf_dir)
    ok = F.size("v").isin(*DIMS) & ~F.exists("v", lambda x: F.isnan(x))
    counts = sent.agg(F.count(F.lit(1)).alias("sent"), F.count(F.when(ok, 1)).alias("accepted"))
    deleted = stored_vectors(sent).agg(F.count(F.when(F.col("vec_id") % 10 == 7, 1)).alias("deleted"))
    return counts.join(deleted)  # one row each


@query(SCORES + """, r AS (SELECT query_id, label, vec_id, least(1.0, greatest(-1.0, score)) AS similarity, row_number() OVER (PARTITION BY query_id, label ORDER BY vec_id) - 1 AS idx FROM s)
    SELECT query_id, label, arg_min(idx, (-similarity, idx)) AS best_index, max(similarity) AS similarity FROM r GROUP BY 1, 2""")
def jn22_passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of every item for each query, the first of equals."""
    rows = stored(spark, sf_dir)
    passages = rows.select(F.col("label").alias("item"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("idx"), "embedding")
    return best_passages(passages, asked_vectors(rows)).withColumnRenamed("item", "label")


def bm25_sql(index: str = "documents", k: int = 20) -> str:
    return f"""
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM {index}),
    len AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1),
    stats AS (SELECT (SELECT count(*) FROM {index}) AS n, avg(dl) AS avgdl FROM len),
    ask AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+'))) AS word FROM benchmark WHERE item_id % 50 = 0),
    tf AS (SELECT doc_id, word, count(*) AS f FROM t WHERE word IN (SELECT word FROM ask) GROUP BY 1, 2),
    df AS (SELECT word, count(*) AS d FROM tf GROUP BY 1),
    hits AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM ask JOIN tf USING (word) JOIN df USING (word) JOIN len USING (doc_id), stats GROUP BY 1, 2),
    lexical AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= {k})
    """


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every benchmark item whose id is divisible by fifty."""
    bench = views.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0")
    return bench.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)")))).alias("word"))


@query("WITH " + bm25_sql() + " SELECT item_id, doc_id, score, rank FROM lexical")
def vec5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of whole benchmark items over all documents, k1 = 1.2, b = 0.75; the twenty best of each."""
    return bm25(views.table(spark, sf_dir, "documents"), asked_words(spark, sf_dir), 20)


def fused_sql(index: str) -> str:
    return f"""
    WITH {bm25_sql(index, 50)},
    dense AS (SELECT b.item_id, e.vec_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, 'v' || e.vec_id) AS rank
              FROM (SELECT item_id FROM benchmark WHERE item_id % 50 = 0) b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e QUALIFY rank <= 50),
    both_lists AS (SELECT coalesce(d.item_id, l.item_id) AS query_id, coalesce(d.id, l.doc_id) AS id, d.rank AS dense_rank, l.rank AS lexical_rank, round(coalesce(0.7 / (60 + d.rank), 0) + coalesce(0.3 / (60 + l.rank), 0), 8) AS rrf
             FROM dense d FULL JOIN lexical l ON d.item_id = l.item_id AND d.id = l.doc_id)
    SELECT query_id, id, dense_rank, lexical_rank, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM both_lists QUALIFY rank <= 20
    """


def fused(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Vectors and texts of one id are one entry; an item is asked by its vector and its words."""
    rows = stored(spark, sf_dir).withColumn("id", F.col("vec_id").cast("long"))
    items = views.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").cast("long").alias("query_id"))
    asked = items.join(rows.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")), "query_id")
    dense = top_k(rows, asked, 50, keep=["id"])
    lexical = bm25(docs, asked_words(spark, sf_dir), 50).select(F.col("item_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("id"), "rank")
    return hybrid(dense, lexical, 20, weights=(0.7, 0.3))


@query(fused_sql("documents"))
def rnk3_hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25 lists of fifty, fused by weighted reciprocal ranks, the twenty best of each query."""
    return fused(spark, sf_dir, views.table(spark, sf_dir, "documents"))


INDEX = "(SELECT doc_id, text FROM documents WHERE doc_id % 9 <> 4 UNION ALL SELECT doc_id, 'new ' || coalesce(text, '') FROM documents WHERE doc_id % 9 = 4)"


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a batch of updates: of each key the row of the last batch."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    batch = docs.where("doc_id % 9 = 4").select("doc_id", F.concat(F.lit("new "), F.coalesce("text", F.lit(""))).alias("text"))
    rows = docs.withColumn("seq", F.lit(0)).unionByName(batch.withColumn("seq", F.lit(1)))
    return rows.groupBy("doc_id").agg(F.max_by("text", "seq").alias("text"))


@query(f"SELECT count(*) AS entries, count(*) FILTER (doc_id % 9 = 4) AS batch, count(*) FILTER (starts_with(text, 'new ')) AS updated FROM {INDEX}")
def snk3_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch written to the search index: entries, the batch's length, and entries that show it."""
    one = lambda c: F.count(F.when(c, 1))
    return upserted(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), one(F.col("doc_id") % 9 == 4).alias("batch"), one(F.col("text").startswith("new ")).alias("updated"))


@query(fused_sql(INDEX))
def vec6_hybrid_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole service: upsert a batch, ask both lists of the new index, fuse."""
    return fused(spark, sf_dir, upserted(spark, sf_dir))


@query("""
    WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS text, CASE WHEN (conv_id + turn) % 4 = 0 THEN [1.0, 2.0] END AS given FROM conversations)
    SELECT conv_id, turn, CASE WHEN given IS NOT NULL THEN 'given' WHEN trim(coalesce(text, '')) <> '' THEN 'encoded' ELSE 'none' END AS origin,
           CAST(CASE WHEN given IS NOT NULL THEN 3.0 WHEN trim(coalesce(text, '')) <> '' THEN list_sum(list_transform(list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w: (length(w) * 31 + unicode(w)) % 64), lambda p: CASE WHEN p < 32 THEN 1.0 ELSE 0.0 END)) END AS DOUBLE) AS mass
    FROM q
""")
def rnk4_query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector given with a query, else that of its text, else none. (mass: of the given vector, or of
    the lower half of the text's.)"""
    q = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"), F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.array(F.lit(1.0), F.lit(2.0))).alias("given"))
    spoken = F.trim(F.coalesce("text", F.lit(""))) != ""
    encoded = F.when(spoken, F.slice(V.hashed_words(F.col("text")), 1, 32))
    total = F.aggregate(F.coalesce("given", encoded), F.lit(0.0), lambda s, x: s + x)
    return q.select("conv_id", "turn", F.when(F.col("given").isNotNull(), "given").when(spoken, "encoded").otherwise("none").alias("origin"), total.alias("mass"))


@query("SELECT vec_id, embedding IS NOT NULL AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0.0 AS valid FROM embeddings")
def vec3_valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an allowed dimension, a positive length and no NaN."""
    bad = F.exists("embedding", lambda x: F.isnan(x)) | ~F.size("embedding").isin(*DIMS)
    return stored(spark, sf_dir).select("vec_id", (~bad & (V.norm(F.col("embedding")) > 0)).alias("valid"))


@query("""
    WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
    r AS (SELECT conv_id, count(*) AS texts, sum(strlen(text)) AS bytes, max(length(text)) AS longest FROM c GROUP BY 1)
    SELECT c.conv_id, c.turn, CASE WHEN r.texts > 4 OR r.bytes > 600 THEN 'refused' WHEN length(c.text) > 250 THEN 'too long' WHEN place > 3 THEN 'cut off' ELSE 'taken' END AS outcome FROM c JOIN r USING (conv_id)
""")
def lim2_request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the texts of a request: refused as a whole beyond a number or a sum of bytes, refused one
    by one beyond a length, and cut off after the most that are embedded (limits are parameters)."""
    return request_limits(views.table(spark, sf_dir, "conversations"), most_texts=4, most_bytes=600, most_chars=250, embedded=3)
