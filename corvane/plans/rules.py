"""Small rules on tags, files and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources import views
from .base import query

# Extensions of video and audio files (fixed values).
VIDEO = "mp4 mkv mov avi wmv flv webm m4v mpeg mpg 3gp ogv rm rmvb asf vob f4v m2ts mxf dv".split()
AUDIO = "mp3 wav flac aac ogg m4a wma aiff opus ape dsd dsf dff mqa ac3 dts ra au snd caf amr 3ga mid midi weba oga".split()
# Language codes and their concept names (fixed values).
LANGUAGES = {"zh": "chinese", "en": "english", "ja": "japanese", "ko": "korean", "fr": "french", "de": "german", "es": "spanish", "pt": "portuguese", "ru": "russian", "it": "italian", "ar": "arabic", "th": "thai", "vi": "vietnamese", "hi": "hindi", "nl": "dutch"}
CLASSIC_ENCODERS, UNIFIED_ENCODERS = (0, 1), (4,)


def _map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


@query("SELECT file, code, dim FROM scored_tags WHERE code NOT IN ('builtin.R') AND NOT (dim = 'F' AND code = 'builtin.A')")
def flt18_exclusive_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that other kinds of files own go from documents (here: dimension F)."""
    banned = spark.createDataFrame([("builtin.R", None), ("builtin.A", "F")], "code string, of string")
    tags = views.scored_tags(spark, sf_dir)
    hit = (tags["code"] == banned["code"]) & (banned["of"].isNull() | (banned["of"] == tags["dim"]))
    return tags.join(F.broadcast(banned), hit, "left_anti").select("file", "code", "dim")  # the list is the caller's


@query("""
    SELECT word, word IN ('stop', 'gate', 'the') OR word IN ('der') AS gate FROM words
""")
def flt19_gate_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a gate list by code or loose alias."""
    gate = spark.createDataFrame([(w,) for w in ("stop", "gate", "the", "der")], "word string").withColumn("gate", F.lit(True))
    return views.words(spark, sf_dir).join(gate, "word", "left").select("word", F.coalesce("gate", F.lit(False)).alias("gate"))


@query("SELECT code, name, parent FROM tag_nodes WHERE parent IS DISTINCT FROM 'r1' AND code <> 'r1'")
def flt20_subdivision_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a subdivision go, by parent or by code."""
    return views.tag_nodes(spark, sf_dir).where(~F.col("parent").eqNullSafe("r1") & (F.col("code") != "r1"))


@query("SELECT doc_id, path, regexp_matches(path, '^/src1[0-9]*/.*$') AS excluded FROM (SELECT doc_id, '/' || source || '/' || doc_id AS path FROM documents)")
def flt21_excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcard patterns of excluded paths: * is any text, everything else is literal."""
    pattern = "^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in "/src1*".split("*"))
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"))
    return rows.select("doc_id", "path", F.col("path").rlike(pattern).alias("excluded"))


@query("""
    WITH r AS (SELECT word, (['n', ' C ', 'n', 'v', 'U', 'p ', NULL])[1 + (length(word) + unicode(word)) % 7] AS pos, CASE WHEN length(word) % 3 = 0 THEN 'noun.tops' WHEN length(word) % 3 = 1 THEN 'noun.food' END AS lexfile FROM words)
    SELECT word, pos, lexfile, CASE WHEN lower(trim(pos)) IN ('c', 'u', 'p') THEN 'pos' WHEN lexfile IN ('noun.tops') THEN 'lexfile' WHEN word IN ('thing', 'part', 'the') THEN 'lemma' ELSE 'ok' END AS rejected FROM r
""")
def flt22_lexical_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed word classes, banned lexicographer files and banned lemmas, the first of them."""
    n = F.char_length("word")
    pos = F.get(F.array(*map(F.lit, ["n", " C ", "n", "v", "U", "p ", None])), ((n + F.ascii("word")) % 7).cast("int"))
    rows = views.words(spark, sf_dir).select("word", pos.alias("pos"), F.when(n % 3 == 0, "noun.tops").when(n % 3 == 1, "noun.food").alias("lexfile"))
    low = lambda c: F.lower(F.trim(c))
    return rows.withColumn("rejected", F.when(low("pos").isin("c", "u", "p"), "pos").when(F.col("lexfile").isin("noun.tops"), "lexfile").when(low("word").isin("thing", "part", "the"), "lemma").otherwise("ok"))


@query("SELECT file, list(DISTINCT code ORDER BY code) AS codes FROM scored_tags WHERE code IN ('builtin.A', 'builtin.N') GROUP BY 1")
def set3_surviving_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags whose code is in the surviving set."""
    survivors = spark.createDataFrame([("builtin.A",), ("builtin.N",)], "code string")
    return views.scored_tags(spark, sf_dir).join(survivors, "code", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("code")).alias("codes"))


@query("""
    WITH t AS (SELECT file, dim, code, max(confidence) AS c FROM scored_tags GROUP BY 1, 2, 3),
    b AS (SELECT file, code, max(c) AS c FROM t GROUP BY 1, 2),
    lost AS (SELECT x.file, CASE WHEN x.c >= y.c THEN y.code ELSE x.code END AS code FROM b x JOIN b y ON x.file = y.file AND x.code = 'builtin.A' AND y.code = 'builtin.R')
    SELECT dim, count(*) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.file = t.file AND l.code = t.code) GROUP BY 1
""")
def set5_cross_set_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict over several lists of a file removes the loser from all of them."""
    from ..operators.arbitration import opposition_losers

    t = views.scored_tags(spark, sf_dir).groupBy("file", "dim", "code").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("file").orderBy("code", "dim")
    losers = opposition_losers(t.withColumn("ordinal", F.row_number().over(order)), [("builtin.A", "builtin.R")])
    return t.join(losers, ["file", "code"], "left_anti").groupBy("dim").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS concept, count(*) AS n FROM documents GROUP BY 1, 2")
def str13_language_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("lang", F.try_element_at(_map(LANGUAGES), F.col("lang")).alias("concept"), "n")


_sql = lambda values: ", ".join(f"'{x}'" for x in values)


@query(f"""
    WITH x AS (SELECT DISTINCT '.' || upper(word) AS ext FROM words UNION SELECT unnest([{_sql(VIDEO + AUDIO)}]) UNION SELECT unnest(['..mp4', 'ts', 'alac', '', '.']))
    SELECT ext, CASE WHEN lower(ltrim(ext, '.')) IN ({_sql(VIDEO)}) THEN 'video' WHEN lower(ltrim(ext, '.')) IN ({_sql(AUDIO)}) THEN 'audio' ELSE 'other' END AS kind FROM x
""")
def str33_media_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots in front and case aside."""
    given = spark.createDataFrame([(x,) for x in (*VIDEO, *AUDIO, "..mp4", "ts", "alac", "", ".")], "ext string")
    rows = views.words(spark, sf_dir).select(F.concat(F.lit("."), F.upper("word")).alias("ext")).union(given).distinct()
    clean = F.lower(F.ltrim("ext", F.lit(".")))
    return rows.select("ext", F.when(clean.isin(VIDEO), "video").when(clean.isin(AUDIO), "audio").otherwise("other").alias("kind"))


@query(r"""
    SELECT id, replace(path, '/', '\') AS native, 'path:"' || rtrim(trim(CASE WHEN id % 2 = 0 THEN ' ' || path || '//' ELSE path END), '/\') || '" report' AS phrase FROM workspace_files
""")
def str34_native_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with another separator, and the phrase that asks the index for a keyword below one."""
    asked = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "path", F.lit("//"))).otherwise(F.col("path"))
    folder = F.rtrim(F.trim(asked), F.lit("/\\"))
    return views.workspace_files(spark, sf_dir).select("id", F.translate("path", "/", "\\").alias("native"), F.concat(F.lit('path:"'), folder, F.lit('" '), F.trim(F.lit(" report "))).alias("phrase"))


@query("""
    SELECT p_partkey, 'see ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '{{img1}}' END || ' and ' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' {{x' ELSE '' END || p_brand AS filled FROM part
""")
def str38_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text in the place of its marks, every mark of a picture, unknown ones stay."""
    part = views.table(spark, sf_dir, "part")
    text = F.concat(F.lit("see {{img1}} and {{img2}}"), F.when(F.col("p_size") % 3 == 0, " {{x").otherwise(""), F.lit("{{img2}}"))
    found = F.map_from_arrays(F.array(F.when(F.col("p_size") % 2 == 0, "img1").otherwise("none"), F.lit("img2")), F.array("p_type", "p_brand"))
    rows = part.select("p_partkey", text.alias("t"), found.alias("found"))
    filled = F.aggregate(F.map_entries("found"), F.col("t"), lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    return rows.select("p_partkey", filled.alias("filled"))


@query("SELECT p_partkey, p_name AS tag, 'builtin.' || lower(replace(p_brand, '#', '_')) AS concept, p_name = 'red widget' AS matches FROM part")
def str9_tag_matches_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag matches a concept by code, else by name."""
    code = F.concat(F.lit("builtin."), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))))
    by_code = F.when(F.col("p_name").startswith("builtin."), F.col("p_name") == code)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("tag"), code.alias("concept"), F.coalesce(by_code, F.lower("p_name") == "red widget").alias("matches"))


@query("""
    SELECT DISTINCT role || '|' || CASE WHEN turn % 2 = 0 THEN 64 ELSE 384 END || '|' || sha256(trim(coalesce(text, ''))) AS key FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''
""")
def hsh4_encode_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is encoded once: an encoder, a dimension and a text; blank texts and other encoders are not."""
    c = views.table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    text = F.trim(F.coalesce("text", F.lit("")))
    key = F.concat_ws("|", "role", F.when(F.col("turn") % 2 == 0, 64).otherwise(384).cast("string"), F.sha2(text, 256))
    return c.where(text != "").select(key.alias("key")).distinct()


@query("""
    WITH r AS (SELECT p_partkey, (['classic', 'unified', NULL])[1 + p_partkey % 3] AS profile, ([384, 7, NULL, 256, 768, 512, 64])[1 + p_size % 7] AS given FROM part)
    SELECT p_partkey, CASE WHEN given IN (64, 256, 384, 512, 768) THEN given WHEN profile = 'unified' THEN 768 ELSE 512 END AS dim FROM r
""")
def mth4_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked-for dimension if it is allowed, else the profile's own."""
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    rows = views.table(spark, sf_dir, "part").select("p_partkey", at(["classic", "unified", None], F.col("p_partkey") % 3).alias("profile"), at([384, 7, None, 256, 768, 512, 64], F.col("p_size") % 7).alias("given"))
    ok = F.coalesce(F.col("given").isin(64, 256, 384, 512, 768), F.lit(False))
    return rows.select("p_partkey", F.when(ok, F.col("given")).when(F.col("profile") == "unified", 768).otherwise(512).alias("dim"))


@query("""
    SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))), 3) AS km
    FROM (SELECT n_nationkey, n_regionkey, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.0 - 160 AS lng FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.0 - 160 AS lng FROM nation) b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def mth9_great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lng"))
    a, b = p.toDF("a", "n_regionkey", "alat", "alng"), p.toDF("b", "n_regionkey", "blat", "blng")
    half = F.sin(F.radians(F.col("blat") - F.col("alat")) / 2) ** 2 + F.cos(F.radians("alat")) * F.cos(F.radians("blat")) * F.sin(F.radians(F.col("blng") - F.col("alng")) / 2) ** 2
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(half))), 3).alias("km"))


@query("""
    WITH d AS (SELECT doc_id, text, doc_id % 6 = 0 AS owned, doc_id % 9 = 0 AS short FROM documents),
    j AS (SELECT d.*, e.vec_id IS NOT NULL AND e.label % 5 IN (0, 1) AS kept FROM d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
    o AS (SELECT doc_id, CASE WHEN owned AND NOT short THEN 'given' WHEN kept THEN 'stored' WHEN trim(coalesce(text, '')) <> '' THEN 'encoded' END AS origin FROM j)
    SELECT doc_id, origin FROM o WHERE origin IS NOT NULL
""")
def clu2_vector_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's own vector of the right dimension, else the stored one of an allowed encoder, else one of its
    text; documents without any drop."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when((F.col("label") % 5).isin(*CLASSIC_ENCODERS), F.col("embedding")).alias("kept"))
    own = F.when(F.col("doc_id") % 6 == 0, F.when(F.col("doc_id") % 9 == 0, F.array_repeat(F.lit(1.0), 8)).otherwise(F.array_repeat(F.lit(1.0), 64)))
    made = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", V.hashed_words(F.col("text")))
    fits = lambda v: F.size(v) == 64
    rows = docs.join(e, "doc_id", "left").select("doc_id", own.alias("own"), "kept", made.alias("made"))
    origin = F.when(fits(F.col("own")), "given").when(fits(F.col("kept")), "stored").when(fits(F.col("made")), "encoded")
    return rows.select("doc_id", origin.alias("origin")).where("origin IS NOT NULL")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: x * x))), 6) END AS first FROM embeddings")
def clu4_prompt_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt vectors cut to the clusters' dimension, ignored where that is impossible."""
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(V.fit(v, 32), F.lit(0)), 6).alias("first"))


@query("""
    SELECT conv_id, turn, 'c' || conv_id || ':tc' || turn AS fingerprint, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS encoder_id FROM conversations UNION ALL
    SELECT conv_id, NULL, 'c' || conv_id, 0 FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def snk6_ingest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an item's text parts and of the item itself."""
    c = views.table(spark, sf_dir, "conversations")
    parts = c.select("conv_id", "turn", F.concat(F.lit("c"), "conv_id", F.lit(":tc"), "turn").alias("fingerprint"), F.when(F.col("role") == "user", 1).otherwise(2).alias("encoder_id"))
    whole = c.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.concat(F.lit("c"), "conv_id").alias("fingerprint"), F.lit(0).alias("encoder_id"))
    return parts.unionByName(whole)


@query("""
    WITH s AS (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN toxic IS NULL THEN 'skipped' WHEN toxic = 1 THEN 'flagged' ELSE 'clean' END AS state FROM s
""")
def txt12_slot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id").join(views.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("toxic").isNull(), "skipped").when(F.col("toxic") == 1, "flagged").otherwise("clean").alias("state"))


@query("""
    WITH w AS (SELECT DISTINCT doc_id, word, (length(word) * 31 + unicode(word)) % 400 AS word_vec FROM tokens),
    known AS (SELECT word, 'builtin.k_' || word AS code FROM words WHERE unicode(word) % 7 = 0),
    a AS (SELECT w.doc_id, w.word, k.code, list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS near
          FROM w LEFT JOIN known k USING (word) LEFT JOIN embeddings d ON d.vec_id = w.doc_id AND w.doc_id % 10 <> 9 LEFT JOIN embeddings e ON e.vec_id = w.word_vec)
    SELECT doc_id, word, coalesce(code, '_ext.' || trim(regexp_replace(word, '[^a-z0-9]+', '_', 'g'), '_') || '.' || left(sha256(word), 8)) AS code, code IS NULL AS minted
    FROM a WHERE code IS NOT NULL OR (near >= 0.36 AND regexp_matches(word, '[a-z]') AND word NOT IN ('the', 'and', 'of', 'to', 'der', 'die', 'und', 'les', 'des', 'que', 'los', 'las', 'una', 'null', 'none', 'unknown', 'undefined', 'other')
             AND NOT (regexp_matches(word, '^[a-f]+$') AND length(word) IN (8, 16, 32, 40, 64)))
""")
def txt9_text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controlled codes of a text's words. A word without one gets a new code only if the admissibility rules
    accept it and its vector is near that of the text; a text without a vector mints none."""
    from .identify import FRAMES, RESERVED, STOPWORDS

    words = views.tokens(spark, sf_dir).distinct().withColumn("word_vec", (F.char_length("word") * 31 + F.ascii("word")) % 400)
    known = views.words(spark, sf_dir).where(F.ascii("word") % 7 == 0).select("word", F.concat(F.lit("builtin.k_"), "word").alias("code"))
    joined = words.join(known, "word", "left")
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # words are judged and compared only where no code is known, each pair of vectors once
    open_words = joined.where("code IS NULL AND doc_id % 10 <> 9")
    open_words = open_words.where(F.col("word").rlike("[a-z]") & (T.tag_verdict(F.col("word"), STOPWORDS, RESERVED, FRAMES) == "ok"))
    pairs = open_words.select("doc_id", "word_vec").distinct()
    pairs = pairs.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("d")), "doc_id").join(e.select(F.col("vec_id").cast("int").alias("word_vec"), F.col("embedding").alias("w")), "word_vec")
    near = pairs.where(V.cosine(F.col("d"), F.col("w")) >= 0.36).select("doc_id", "word_vec")
    minted = open_words.join(near, ["doc_id", "word_vec"], "left_semi").select("doc_id", "word", T.extension_code(F.col("word")).alias("code"), F.lit(True).alias("minted"))
    return joined.where("code IS NOT NULL").select("doc_id", "word", "code", F.lit(False).alias("minted")).unionByName(minted)


@query("""
    WITH t AS (SELECT file, code, max(confidence) AS real, min(ordinal) AS o FROM scored_tags GROUP BY 1, 2)
    SELECT file, code, CASE WHEN o % 3 = 0 THEN real WHEN code = 'builtin.A' THEN 0.99 WHEN code = 'builtin.N' THEN 0.90 ELSE 0.55 END AS confidence FROM t
""")
def arb9_layered_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured confidence, else that of the tag's layer."""
    t = views.scored_tags(spark, sf_dir).groupBy("file", "code").agg(F.max("confidence").alias("m"), F.min("ordinal").alias("o"))
    layer = F.when(F.col("code") == "builtin.A", 0.99).when(F.col("code") == "builtin.N", 0.90).otherwise(0.55)
    return t.select("file", "code", F.coalesce(F.when(F.col("o") % 3 == 0, F.col("m")), layer).alias("confidence"))
