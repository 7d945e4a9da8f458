"""Enriched corpora, generation checks, cascaded look-ups and forced tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..sources import views
from .base import query

# Extensions by category (fixed values); the table is a parameter of ``by_extension``.
EXTENSIONS = {
    "image": "png jpg jpeg gif webp bmp svg avif tif tiff heic".split(),
    "video": "mp4 m4v webm ogv mov mkv avi".split(),
    "audio": "mp3 wav flac aac m4a opus ogg".split(),
    "document": "pdf docx doc pptx ppt xlsx xls txt md html htm csv rtf odt epub".split(),
    "archive": "zip rar 7z tar gz bz2 xz".split(),
    "code": "py rs c h cpp java go js ts sql sh json yaml toml".split(),
}


def by_extension(files: DataFrame, table: dict[str, list[str]] = EXTENSIONS) -> DataFrame:
    """``files`` (with a column ``name``) plus extension and category; unknown ones are ``other``."""
    known = F.create_map(*[F.lit(x) for kind, names in table.items() for e in names for x in (e, kind)])
    ext = F.lower(F.regexp_extract("name", "\\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("ext", ext).withColumn("category", F.coalesce(F.try_element_at(known, F.col("ext")), F.lit("other")))


@query("""
    WITH f AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.mkv' WHEN 2 THEN '.tar' WHEN 3 THEN '.rs' WHEN 4 THEN '.odt' ELSE '.zzz' END AS name FROM part)
    SELECT p_partkey, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE p_partkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'archive' WHEN 3 THEN 'code' WHEN 4 THEN 'document' ELSE 'other' END AS category FROM f
""")
def str31_extension_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, ".HEIC").when(k == 1, ".mkv").when(k == 2, ".tar").when(k == 3, ".rs").when(k == 4, ".odt").otherwise(".zzz")
    files = views.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("name"))
    return by_extension(files).select("p_partkey", "ext", "category")


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN p_name || ' after' WHEN 3 THEN '' ELSE p_name END AS clean FROM part
""")
def str26_template_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, time stamps and headings of a template go, what stands between them stays."""
    name, key = F.col("p_name"), F.col("p_partkey") % 5
    text = F.when(key == 0, F.concat(F.lit("[Class] "), name)).when(key == 1, F.concat(name, F.lit(" 产生时间: 2024-01-01。after"))).when(key == 2, F.concat(F.lit("核心要点："), name)).when(key == 3, "  ").otherwise(name)
    return views.table(spark, sf_dir, "part").select("p_partkey", E.strip_template(text).alias("clean"))


@query("""
    WITH d AS (SELECT doc_id, lang, text FROM documents)
    SELECT doc_id AS id, ['About ' || lang, 'Source'] AS headings FROM d
""")
def str27_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in front of the texts are found, each once, page marks and front matter are not."""
    docs = views.table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# About "), "lang", F.lit("\n## Page 3\n# Contents\n## Source\n# Source\n"), F.coalesce(F.regexp_replace("text", "(?m)^#", ""), F.lit("")))
    return docs.select(F.col("doc_id").alias("id"), E.outline(body).alias("headings"))


@query()
def str27_enriched_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("[Note] 主要内容: "), "lang").alias("summary"), F.array("source", F.lit("page")).alias("keywords"), F.array().cast("array<string>").alias("entities"), F.col("text").alias("body"))
    return E.enriched_corpus(rows)


@query("""
    SELECT event_id, event_id % 6 IN (0, 2, 3) AS degenerate FROM events
""")
def str37_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token four times, two three times over, four twice over; not three of one, nor what only looks alike."""
    x, key = (F.col("event_id") % 1000).cast("int"), F.col("event_id") % 6
    run = lambda *steps: F.array(*[(x + k).cast("int") for k in steps])
    tokens = F.when(key == 0, run(9, 5, 5, 5, 5)).when(key == 1, run(5, 5, 5)).when(key == 2, run(1, 2, 1, 2, 1, 2)).when(key == 3, run(1, 2, 3, 4, 1, 2, 3, 4)).when(key == 4, run(1, 2, 3, 4, 5, 6, 7, 8)).otherwise(F.array().cast("array<int>"))
    return views.table(spark, sf_dir, "events").select("event_id", E.is_degenerate(tokens).alias("degenerate"))


@query("""
    SELECT event_id, event_id % 6 IN (0, 2, 3) AS complete FROM events
""")
def str36_json_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced braces outside of strings: whole objects, with space around or nested, but no torn ones, lists or blanks."""
    props, key = F.col("props"), F.col("event_id") % 6
    torn = F.substring(props, F.lit(1), F.char_length(props) - 1)
    nested = F.concat(F.lit('{"a": '), props, F.lit(', "b": "}\\" {"}'))
    text = F.when(key == 0, props).when(key == 1, torn).when(key == 2, F.concat(F.lit(" "), props, F.lit(" "))).when(key == 3, nested).when(key == 4, "[1]").otherwise("")
    return views.table(spark, sf_dir, "events").select("event_id", E.is_complete_json(text).alias("complete"))


@query("""
    WITH o AS (SELECT tag_code, arg_min(lemma, (length(lemma), lemma)) AS name FROM tag_aliases GROUP BY 1) SELECT tag_code, name FROM o
""")
def rnk7_display_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a code's names that with most characters beyond ASCII, then the shortest, then the first."""
    wide = F.char_length(F.regexp_replace("lemma", "[\\x00-\\x7F]", ""))
    return views.tag_aliases(spark, sf_dir).groupBy("tag_code").agg(F.min_by("lemma", F.struct((-wide).alias("w"), F.char_length("lemma").alias("n"), F.col("lemma"))).alias("name"))


@query()
def rnk8_diverse_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diverse_keywords(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""
    WITH a AS (SELECT DISTINCT lemma, locale, tag_code FROM tag_aliases),
    one AS (SELECT locale, lemma, min(tag_code) AS code FROM a GROUP BY 1, 2),
    asked AS (SELECT DISTINCT lemma AS word, CASE WHEN length(lemma) % 2 = 0 THEN 'fr' ELSE 'de' END AS language FROM a UNION SELECT 'unseen', 'fr')
    SELECT word, language, coalesce(own.code, en.code, CASE WHEN word = 'unseen' THEN 'builtin.static' END) AS code
    FROM asked LEFT JOIN one own ON own.lemma = word AND own.locale = language LEFT JOIN one en ON en.lemma = word AND en.locale = 'en'
""")
def jn15_two_stage_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word's own language, then English, then the static map."""
    one = views.tag_aliases(spark, sf_dir).groupBy("locale", F.col("lemma").alias("word")).agg(F.min("tag_code").alias("code"))
    words = views.tag_aliases(spark, sf_dir).select(F.col("lemma").alias("word")).distinct().withColumn("language", F.when(F.char_length("word") % 2 == 0, "fr").otherwise("de"))
    asked = words.union(spark.createDataFrame([("unseen", "fr")], "word string, language string"))
    own = one.select("word", F.col("locale").alias("language"), F.col("code").alias("own"))
    english = one.where("locale = 'en'").select("word", F.col("code").alias("english"))
    static = spark.createDataFrame([("unseen", "builtin.static")], "word string, static string")
    joined = asked.join(own, ["word", "language"], "left").join(english, "word", "left").join(static, "word", "left")
    return joined.select("word", "language", F.coalesce("own", "english", "static").alias("code"))


@query("""
    WITH RECURSIVE up AS (SELECT code, parent AS ancestor, 1 AS d FROM tag_nodes WHERE parent IS NOT NULL
        UNION ALL SELECT u.code, t.parent, d + 1 FROM up u JOIN tag_nodes t ON t.code = u.ancestor WHERE t.parent IS NOT NULL AND d < 5),
    c AS (SELECT DISTINCT name, code, row_number() OVER (PARTITION BY name ORDER BY code) AS rank FROM (SELECT DISTINCT name, code FROM tag_nodes)),
    m AS (SELECT c.name, c.code, c.rank, bool_or(coalesce(u.ancestor = 'r2', FALSE)) AS matched FROM c LEFT JOIN up u ON u.code = c.code GROUP BY 1, 2, 3)
    SELECT name, arg_min(code, (NOT matched, rank)) AS code, bool_or(matched) AS matched FROM m GROUP BY 1
""")
def jn6_first_under_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's first candidate below the asked ancestor, else its first candidate."""
    from ..operators.graph import ancestors

    nodes = views.tag_nodes(spark, sf_dir)
    under = ancestors(nodes, 5).where("ancestor = 'r2'").select("code", F.lit(True).alias("below"))
    found = nodes.select("name", "code").distinct().join(under, "code", "left").withColumn("m", F.coalesce("below", F.lit(False)))
    return found.groupBy("name").agg(F.min_by("code", F.struct((~F.col("m")).alias("no"), "code")).alias("code"), F.bool_or("m").alias("matched"))


@query("""
    SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN ['with_text'] ELSE ['without_text', 'colour'] END AS tags FROM conversations
""")
def arb8_forced_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found text forces its tag and removes the opposite; black-and-white gives way to colour."""
    c = views.table(spark, sf_dir, "conversations")
    has_text = F.char_length("text") > 100
    tags = F.when(has_text, F.array(F.lit("without_text"))).otherwise(F.array(F.lit("without_text"), F.lit("black_white"), F.lit("colour")))
    forced = F.when(has_text, F.array_union(F.filter(tags, lambda t: t != "without_text"), F.array(F.lit("with_text")))).otherwise(tags)
    coloured = F.when(F.array_contains(forced, "colour"), F.filter(forced, lambda t: t != "black_white")).otherwise(forced)
    return c.select("conv_id", "turn", coloured.alias("tags"))


@query("""
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'confidential' WHEN source IN ('src0', 'src1') THEN 'internal' ELSE 'public' END AS level
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def str35_security_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level by source; sensitive content raises it."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source").join(views.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("toxic") == 1, "confidential").when(F.col("source").isin("src0", "src1"), "internal").otherwise("public").alias("level"))


@query("""
    WITH w AS (SELECT doc_id, count(*) AS n, count(*) FILTER (word IN ('trash', 'worthless', 'disgusting')) AS bad FROM tokens GROUP BY 1)
    SELECT d.doc_id, coalesce(bad, 0) AS hits, CASE WHEN coalesce(bad, 0) = 0 THEN 'clean' WHEN bad >= 3 THEN 'flagged' ELSE 'mild' END AS rating FROM documents d LEFT JOIN w USING (doc_id)
""")
def txt11_text_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating by a lexicon; the default list is a neutral demonstration."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"))
    hits = F.size(F.filter(words, lambda w: w.isin("trash", "worthless", "disgusting"))).cast("long")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(hits, F.lit(0)).alias("hits")).withColumn("rating", F.when(F.col("hits") == 0, "clean").when(F.col("hits") >= 3, "flagged").otherwise("mild"))


@query("""
    SELECT n.n_nationkey AS id, n.n_name AS name, r.r_name AS admin, count(c.c_custkey) AS population FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2, 3 HAVING count(c.c_custkey) >= 10
""")
def src13_place_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with their administrative names, the small ones left out."""
    nation, region, customer = (views.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    sizes = customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.count("c_custkey").alias("population")).where("population >= 10")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("admin"))
    return places.join(sizes, "id")
