"""Normal forms of tags, their codes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import text as T
from ..operators.tree import TreeRules
from ..sources import views
from .base import query
from .enrich import EXTENSIONS
from .identify import FRAMES, RESERVED, STOPWORDS

ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)
BANNED = ["thing", "stuff"]
RULES = TreeRules()


@query("SELECT DISTINCT p_name, lower(p_name) || ' ' || lower(p_brand) AS lemma FROM part")
def str1_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters and ideographic space become plain ones before words are compared."""
    part = views.table(spark, sf_dir, "part").select("p_name", F.upper("p_brand").alias("p_brand")).distinct()
    written = F.concat(F.lit("　"), F.translate("p_name", ASCII, WIDE), F.lit("　"), F.translate("p_brand", ASCII, WIDE), F.lit("  "))
    return part.select("p_name", N.lemma(written).alias("lemma")).distinct()


ASKED = """
    asked AS (SELECT DISTINCT p_name AS tag FROM part UNION SELECT ' ' || upper(lemma) || ' ' FROM tag_aliases UNION SELECT ' builtin.' || lower(p_type) || ' ' FROM part UNION SELECT '_ext.' || lower(p_type) || '.0' FROM part
              UNION SELECT unnest(['the', 'thing', ' ', 'null', 'omw.1.n', 'unlisted words']))
"""


def asked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    rows = [part.select("p_name"), views.tag_aliases(spark, sf_dir).select(F.concat(F.lit(" "), F.upper("lemma"), F.lit(" "))), part.select(F.concat(F.lit(" builtin."), F.lower("p_type"), F.lit(" "))), part.select(F.concat(F.lit("_ext."), F.lower("p_type"), F.lit(".0")))]
    out = spark.createDataFrame([(x,) for x in ("the", "thing", " ", "null", "omw.1.n", "unlisted words")], "tag string")
    for r in rows:
        out = out.union(r)
    return out.distinct()


CODES = """
    dict AS (SELECT lower(lemma) AS k, min(tag_code) AS code FROM tag_aliases WHERE locale = 'en' GROUP BY 1)
"""


@query(f"""
    WITH {ASKED}, {CODES}
    SELECT tag, coalesce(code, CASE WHEN regexp_matches(trim(tag), '^(builtin|_ext|omw|hownet)[.]') THEN trim(tag) WHEN lower(trim(tag)) IN ('', 'the', 'thing', 'null') THEN ''
           ELSE '_ext.' || regexp_replace(lower(trim(tag)), '[^a-z0-9]+', '_', 'g') || '.' || left(sha256(trim(tag)), 8) END) AS code
    FROM asked LEFT JOIN dict ON lower(trim(tag)) = k
""")
def str6_tag_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias's code, else the tag if it is a code, else nothing for what the rules or the ban reject, else an open code."""
    words = views.tag_aliases(spark, sf_dir).where("locale = 'en'").groupBy(N.lemma(F.col("lemma")).alias("k")).agg(F.min("tag_code").alias("code"))
    asked = asked_tags(spark, sf_dir).withColumn("k", N.lemma(F.col("tag")))
    clean = T.trim_wide(F.col("tag"))
    rejected = (T.tag_verdict(clean, STOPWORDS, RESERVED, FRAMES) != "ok") | F.lower(clean).isin(BANNED)
    made = F.when(N.is_code(F.col("tag")), clean).when(rejected, "").otherwise(T.extension_code(F.col("tag")))
    return asked.join(words, "k", "left").select("tag", F.coalesce("code", made).alias("code"))


SHOWN = """
    codes AS (SELECT DISTINCT tag_code AS code FROM tag_aliases UNION SELECT 'builtin.h_' || left(sha256(p_name), 8) FROM part UNION SELECT '_ext.' || replace(p_name, ' ', '_') || '.0' FROM part UNION SELECT unnest(['omw.9.n', 'hownet.1.n', 'builtin.deep_blue', '_ext..1', 'plain'])),
    named AS (SELECT tag_code AS code, locale, arg_min(lemma, (-n, lemma)) AS name FROM tag_aliases WHERE is_canonical GROUP BY 1, 2)
"""


@query(f"""
    WITH {SHOWN}, own AS (SELECT code, CASE WHEN starts_with(code, 'builtin.h_') THEN NULL WHEN starts_with(code, 'builtin.') THEN replace(substr(code, 9), '_', ' ')
                                  WHEN starts_with(code, '_ext.') AND split_part(substr(code, 6), '.', 1) <> '' THEN replace(split_part(substr(code, 6), '.', 1), '_', ' ') END AS words FROM codes)
    SELECT o.code, coalesce(f.name, words, e.name, 'Unclassified') AS name FROM own o LEFT JOIN named f ON f.code = o.code AND f.locale = 'fr' LEFT JOIN named e ON e.code = o.code AND e.locale = 'en'
""")
def str7_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name in the language asked for, else the code's own words, else the English name, else that it is unclassified."""
    aliases, part = views.tag_aliases(spark, sf_dir), views.table(spark, sf_dir, "part")
    codes = spark.createDataFrame([(c,) for c in ("omw.9.n", "hownet.1.n", "builtin.deep_blue", "_ext..1", "plain")], "code string").union(aliases.select("tag_code")).union(part.select(F.concat(F.lit("builtin.h_"), T.hash8(F.col("p_name"))))).union(part.select(F.concat(F.lit("_ext."), F.translate("p_name", " ", "_"), F.lit(".0")))).distinct()
    rank = F.struct((-F.col("n")).alias("n"), "lemma")
    named = aliases.where("is_canonical").groupBy(F.col("tag_code").alias("code")).agg(*[F.min_by("lemma", F.when(F.col("locale") == x, rank)).alias(x) for x in ("fr", "en")])
    return codes.join(named, "code", "left").select("code", F.coalesce("fr", N.readable(F.col("code")), "en", N.unclassified(F.lit("fr"))).alias("name"))


@query("""
    WITH c AS (SELECT 'builtin.n' || n_nationkey AS code, n_name AS native, lower(replace(n_name, '_', ' ')) || ' land' AS alias FROM nation),
    raw AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' builtin.n' || c_nationkey || ' ' WHEN 1 THEN 'NATION ' || c_nationkey || ' Land' WHEN 2 THEN 'NATION_' || c_nationkey WHEN 3 THEN 'NÂTÏON_' || c_nationkey WHEN 4 THEN 'nation_' || c_nationkey ELSE ' ' END AS tag FROM customer)
    SELECT c_custkey, tag, CASE c_custkey % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'alias' WHEN 2 THEN 'name' WHEN 3 THEN 'mapped' END AS how, CASE WHEN c_custkey % 6 <= 3 THEN (SELECT code FROM c WHERE c.native = 'NATION_' || regexp_extract(tag, '[0-9]+')) END AS code FROM raw
""")
def str40_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept by its code, else by an alias, else by its native name, else by the name with characters mapped."""
    nation = views.table(spark, sf_dir, "nation").select(F.concat(F.lit("builtin.n"), "n_nationkey").alias("code"), F.col("n_name").alias("native"))
    key = F.col("c_custkey") % 6
    k = F.col("c_nationkey").cast("string")
    tag = F.when(key == 0, F.concat(F.lit(" builtin.n"), k, F.lit(" "))).when(key == 1, F.concat(F.lit("NATION "), k, F.lit(" Land"))).when(key == 2, F.concat(F.lit("NATION_"), k)).when(key == 3, F.concat(F.lit("NÂTÏON_"), k)).when(key == 4, F.concat(F.lit("nation_"), k)).otherwise(" ")
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", tag.alias("tag")).withColumns({"clean": T.trim_wide(F.col("tag"))})
    rows = rows.withColumns({"word": N.lemma(F.col("clean")), "mapped": F.translate("clean", "ÂÏ", "AI")})
    by = {"code": nation.select(F.col("code").alias("clean"), F.col("code").alias("by_code")), "alias": nation.select(N.lemma(F.concat(F.translate("native", "_", " "), F.lit(" land"))).alias("word"), F.col("code").alias("by_alias")),
          "name": nation.select(F.col("native").alias("clean"), F.col("code").alias("by_name")), "mapped": nation.select(F.col("native").alias("mapped"), F.col("code").alias("by_mapped"))}
    how = F.lit(None).cast("string")
    for name, table in by.items():
        rows = rows.join(table, table.columns[0], "left")
    for name in reversed(by):
        how = F.when(F.col(f"by_{name}").isNotNull(), name).otherwise(how)
    return rows.select("c_custkey", "tag", how.alias("how"), F.coalesce(*[f"by_{n}" for n in by]).alias("code"))


@query("""
    WITH p AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN '词' || p_partkey % 7 ELSE p_type END AS alias, p_brand AS en FROM part),
    k AS (SELECT lower(alias) AS key, en, 2 * seq AS s FROM p UNION ALL SELECT lower(en), en, 2 * seq + 1 FROM p),
    m AS (SELECT key, arg_max(en, s) AS en FROM k GROUP BY 1),
    n AS (SELECT en, arg_min(alias, seq) AS native FROM p WHERE starts_with(alias, '词') GROUP BY 1)
    SELECT key, m.en, 'builtin.' || trim(regexp_replace(lower(m.en), '[^a-z0-9]+', '_', 'g'), '_') AS code, native FROM m LEFT JOIN n ON n.en = m.en
""")
def str41_static_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ordered pairs of alias and English name: every word's English (later pairs win), its code, and the first Chinese alias of that English name."""
    part = views.table(spark, sf_dir, "part")
    alias = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("词"), F.col("p_partkey") % 7)).otherwise(F.col("p_type"))
    pairs = part.select(F.col("p_partkey").alias("seq"), alias.alias("alias"), F.col("p_brand").alias("en"))
    keys = pairs.select(N.lemma(F.col("alias")).alias("key"), "en", (2 * F.col("seq")).alias("s")).unionByName(pairs.select(N.lemma(F.col("en")).alias("key"), "en", (2 * F.col("seq") + 1).alias("s")))
    native = pairs.where(F.col("alias").rlike("[\\x{4e00}-\\x{9fff}]")).groupBy("en").agg(F.min_by("alias", "seq").alias("native"))
    return keys.groupBy("key").agg(F.max_by("en", "s").alias("en")).join(native, "en", "left").select("key", "en", T.builtin_code(F.col("en")).alias("code"), "native")


@query(f"""
    WITH c AS (SELECT DISTINCT tag_code AS code FROM tag_aliases UNION SELECT unnest([{", ".join(f"'{r}'" for r in RULES.roots)}, 'builtin.fileType']))
    SELECT code, code IN ({", ".join(f"'{r}'" for r in RULES.roots)}, 'builtin.fileType') AS is_root FROM c
""")
def str42_root_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of the taxonomy, the old spelling of one included."""
    known = [*RULES.roots, *RULES.head_rewrites]
    codes = views.tag_aliases(spark, sf_dir).select(F.col("tag_code").alias("code")).union(spark.createDataFrame([(r,) for r in known], "code string")).distinct()
    return codes.select("code", F.col("code").isin(known).alias("is_root"))


EXTENSION_SQL = " ".join(f"WHEN x IN ({', '.join(repr(e) for e in names)}) THEN '{category}'" for category, names in EXTENSIONS.items())


@query(f"""
    WITH r AS (SELECT DISTINCT ' .' || upper(word) AS ext, word AS x FROM words UNION SELECT unnest(['lnk', '.URL', ' ', 'html']), unnest(['lnk', 'url', '', 'html']))
    SELECT ext, CASE WHEN d IS NOT NULL THEN 'builtin.' || x END AS tag_code, CASE WHEN d IS NOT NULL THEN x END AS tag_name, d AS category, CASE WHEN x IN ('lnk', 'url') THEN 'shortcut' END AS subdivision
    FROM (SELECT *, CASE {EXTENSION_SQL} END AS d FROM r)
""")
def str44_extension_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extension resolves to, by the table given; shortcuts have a subdivision of their own."""
    rows = views.words(spark, sf_dir).select(F.concat(F.lit(" ."), F.upper("word")).alias("ext")).union(spark.createDataFrame([("lnk",), (".URL",), (" ",), ("html",)], "ext string")).distinct()
    clean = F.lower(F.ltrim(F.trim("ext"), F.lit(".")))
    table = spark.createDataFrame([(e, c) for c, names in EXTENSIONS.items() for e in names], "x string, category string")
    found = rows.withColumn("x", clean).join(table, "x", "left")
    known = lambda c: F.when(F.col("category").isNotNull(), c)
    return found.select("ext", known(F.concat(F.lit("builtin."), "x")).alias("tag_code"), known(F.col("x")).alias("tag_name"), "category", F.when(F.col("x").isin("lnk", "url"), "shortcut").alias("subdivision"))


DOMAIN_SQL = " ".join(f"WHEN lower(x) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in N.DOMAINS.items())


@query(f"""
    WITH r AS (SELECT DISTINCT upper(word) AS x FROM words UNION SELECT unnest([{", ".join(repr(w) for words in N.DOMAINS.values() for w in words)}]))
    SELECT x, CASE {DOMAIN_SQL} ELSE 'general' END AS domain FROM r
""")
def str32_media_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(w,) for words in N.DOMAINS.values() for w in words], "x string")
    rows = views.words(spark, sf_dir).select(F.upper("word").alias("x")).union(given).distinct()
    return rows.select("x", N.media_domain(F.col("x")).alias("domain"))


POS = ["n", "nr", "v", "vn", "a", "an", "b", "t", "u", "eng", "x", " ", "m", "e"]


@query(f"""
    WITH r AS (SELECT word, ([{", ".join(repr(p) for p in POS)}])[1 + (length(word) * 7 + unicode(word)) % {len(POS)}] AS pos FROM words)
    SELECT word, pos, trim(pos) = '' OR (pos <> 'eng' AND left(pos, 1) IN ('u', 'c', 'p', 'r', 'd', 'y', 'e', 'o', 'w', 'x', 'm', 'q', 'f')) AS non_entity,
           left(trim(pos), 1) IN ('n', 'a', 'b', 'v') OR pos = 'eng' AS prefix, left(trim(pos), 1) IN ('n', 't') OR pos IN ('vn', 'an', 'eng') AS suffix
    FROM r
""")
def str19_word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that name no thing, and those that open or close a compound."""
    pos = F.get(F.array(*map(F.lit, POS)), (F.char_length("word") * 7 + F.ascii("word")) % len(POS))
    rows = views.words(spark, sf_dir).select("word", pos.alias("pos"))
    return rows.select("word", "pos", N.non_entity(F.col("pos")).alias("non_entity"), N.compound_prefix(F.col("pos")).alias("prefix"), N.compound_suffix(F.col("pos")).alias("suffix"))


@query()
def str28_inspection_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is inspected of a text and a prompt, within a budget of bytes."""
    docs = views.table(spark, sf_dir, "documents")
    prompt = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    body = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return docs.select("doc_id", N.inspection_text(body, prompt).alias("t")).select("doc_id", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("text_sha256"))
