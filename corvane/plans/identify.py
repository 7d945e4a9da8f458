"""Tag identity: codes, aliases and their arbitration, admissibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import views
from .base import query

# A short demonstration list of stop words, reserved words and sentence frames; lists are parameters.
STOPWORDS = ["the", "and", "of", "to", "der", "die", "und", "les", "des", "que", "los", "las", "una"]
RESERVED = ["null", "none", "unknown", "undefined", "other"]
FRAMES = ["such as", "for example"]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_name").distinct()


@query("""
    WITH n AS (SELECT DISTINCT p_name FROM part),
    s AS (SELECT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM n)
    SELECT p_name, slug, CASE WHEN slug = '' THEN 'builtin.h_' || left(sha256(p_name), 8) ELSE 'builtin.' || slug END AS builtin_code,
           CASE WHEN slug = '' THEN '_ext.' || left(sha256(p_name), 8) ELSE '_ext.' || slug || '.' || left(sha256(p_name), 8) END AS ext_code,
           left(sha256(p_name), 8) AS hash8
    FROM s
""")
def str2_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    return names(spark, sf_dir).select("p_name", T.slug(c).alias("slug"), T.builtin_code(c).alias("builtin_code"), T.extension_code(c).alias("ext_code"), T.hash8(c).alias("hash8"))


@query("""
    WITH w AS (SELECT word, strlen(word) AS n FROM words)
    SELECT word, list_filter([
        CASE WHEN ends_with(word, 'ies') AND n > 4 THEN left(word, length(word) - 3) || 'y' END,
        CASE WHEN ends_with(word, 'es') AND n > 3 THEN left(word, length(word) - 2) END,
        CASE WHEN ends_with(word, 'es') AND n > 3 THEN left(word, length(word) - 1) END,
        CASE WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') AND n > 3 THEN left(word, length(word) - 1) END,
        CASE WHEN ends_with(word, 'ied') AND n > 4 THEN left(word, length(word) - 3) || 'y' END,
        CASE WHEN ends_with(word, 'ed') AND n > 4 THEN left(word, length(word) - 2) END,
        CASE WHEN ends_with(word, 'ed') AND n > 4 THEN left(word, length(word) - 1) END,
        CASE WHEN ends_with(word, 'ing') AND n > 5 THEN left(word, length(word) - 3) END,
        CASE WHEN ends_with(word, 'ing') AND n > 5 THEN left(word, length(word) - 3) || 'e' END
    ], lambda x: x IS NOT NULL) AS lemmas FROM w
""")
def jn16_english_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.words(spark, sf_dir).select("word", T.english_lemmas(F.col("word")).alias("lemmas"))


@query("""
    WITH lexicon AS (SELECT word AS lemma, 'code.' || word AS code FROM words WHERE ascii(word) % 2 = 0),
    w AS (SELECT word, strlen(word) AS n FROM words),
    c AS (SELECT word, 0 AS k, word AS form FROM w
          UNION ALL SELECT word, 2, left(word, length(word) - 2) FROM w WHERE ends_with(word, 'es') AND n > 3
          UNION ALL SELECT word, 3, left(word, length(word) - 1) FROM w WHERE ends_with(word, 'es') AND n > 3
          UNION ALL SELECT word, 1, left(word, length(word) - 3) || 'y' FROM w WHERE ends_with(word, 'ies') AND n > 4
          UNION ALL SELECT word, 4, left(word, length(word) - 1) FROM w WHERE ends_with(word, 's') AND NOT ends_with(word, 'ss') AND n > 3
          UNION ALL SELECT word, 5, left(word, length(word) - 3) || 'y' FROM w WHERE ends_with(word, 'ied') AND n > 4
          UNION ALL SELECT word, 6, left(word, length(word) - 2) FROM w WHERE ends_with(word, 'ed') AND n > 4
          UNION ALL SELECT word, 7, left(word, length(word) - 1) FROM w WHERE ends_with(word, 'ed') AND n > 4
          UNION ALL SELECT word, 8, left(word, length(word) - 3) FROM w WHERE ends_with(word, 'ing') AND n > 5
          UNION ALL SELECT word, 9, left(word, length(word) - 3) || 'e' FROM w WHERE ends_with(word, 'ing') AND n > 5)
    SELECT word, arg_min(code, k) AS code FROM c JOIN lexicon ON form = lemma GROUP BY word
""")
def str39_resolve_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word itself, else its first base form that the lexicon has."""
    words = views.words(spark, sf_dir)
    lexicon = words.where(F.ascii("word") % 2 == 0).select(F.col("word").alias("form"), F.concat(F.lit("code."), "word").alias("code"))
    forms = words.select("word", F.posexplode(F.concat(F.array("word"), T.english_lemmas(F.col("word")))).alias("k", "form"))
    return forms.join(lexicon, "form").groupBy("word").agg(F.min_by("code", "k").alias("code"))


@query("""
    WITH ordered AS (SELECT tag_code, locale, lemma, row_number() OVER (PARTITION BY tag_code, locale ORDER BY is_canonical DESC, n DESC, lemma) AS k FROM tag_aliases)
    SELECT tag_code, locale, list(lemma ORDER BY k) AS aliases FROM ordered GROUP BY 1, 2
""")
def agg7_alias_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of a code, canonical first, then by use."""
    rank = F.struct((~F.col("is_canonical")).alias("c"), (-F.col("n")).alias("n"), F.col("lemma"))
    return views.tag_aliases(spark, sf_dir).groupBy("tag_code", "locale").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["lemma"]).alias("aliases"))


@query("""
    WITH first AS (SELECT tag_code, locale, arg_min(lemma, (NOT is_canonical, -n, lemma)) AS name FROM tag_aliases GROUP BY 1, 2)
    SELECT c.tag_code, coalesce(f.name, e.name) AS name, f.name IS NULL AS fallback
    FROM (SELECT DISTINCT tag_code FROM tag_aliases) c LEFT JOIN first f ON f.tag_code = c.tag_code AND f.locale = 'fr' LEFT JOIN first e ON e.tag_code = c.tag_code AND e.locale = 'en'
""")
def agg8_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.struct((~F.col("is_canonical")).alias("c"), (-F.col("n")).alias("n"), "lemma")
    best = views.tag_aliases(spark, sf_dir).groupBy("tag_code").agg(*[F.min_by("lemma", F.when(F.col("locale") == x, rank)).alias(x) for x in ("fr", "en")])
    return best.select("tag_code", F.coalesce("fr", "en").alias("name"), F.col("fr").isNull().alias("fallback"))


@query("""
    SELECT tag_code, locale, max(CASE WHEN is_canonical THEN lemma END) AS canonical, list(lemma ORDER BY lemma) AS aliases FROM tag_aliases GROUP BY 1, 2
""")
def agg20_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tag_aliases(spark, sf_dir)
    return rows.groupBy("tag_code", "locale").agg(F.max(F.when(F.col("is_canonical"), F.col("lemma"))).alias("canonical"), F.array_sort(F.collect_list("lemma")).alias("aliases"))


@query("SELECT tag_code, locale, lemma FROM tag_aliases WHERE tag_code = 'builtin.brand_1' OR starts_with(tag_code, 'builtin.brand_1.')")
def flt5_alias_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact code or anything below it; trailing dots and wildcards of the request are cut."""
    prefix = "builtin.brand_1.%".rstrip(".%")
    return views.tag_aliases(spark, sf_dir).where((F.col("tag_code") == prefix) | F.col("tag_code").startswith(prefix + ".")).select("tag_code", "locale", "lemma")


@query("""
    WITH picked AS (SELECT DISTINCT 'builtin.' || lower(replace(p_brand, '#', '_')) AS tag_code FROM part WHERE p_type IN ('PROMO', 'LARGE'))
    SELECT a.tag_code, count(*) AS aliases FROM tag_aliases a SEMI JOIN picked p ON a.tag_code = p.tag_code GROUP BY 1
""")
def flt7_alias_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part").where(F.col("p_type").isin("PROMO", "LARGE"))
    picked = part.select(F.concat(F.lit("builtin."), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))).alias("tag_code"))
    return views.tag_aliases(spark, sf_dir).join(picked, "tag_code", "left_semi").groupBy("tag_code").agg(F.count(F.lit(1)).alias("aliases"))


@query("""
    WITH a AS (SELECT *, CASE WHEN n % 4 = 0 THEN 3 WHEN n % 4 = 1 THEN 2 WHEN n % 4 = 2 THEN 1 ELSE 0 END AS priority, left(lemma, 6) AS key FROM tag_aliases),
    m AS (SELECT *, first_value(priority) OVER w AS first_priority, first_value(tag_code) OVER w AS first_code, max(CASE WHEN is_canonical THEN priority END) OVER (PARTITION BY locale, key) AS best
          FROM a WINDOW w AS (PARTITION BY locale, key ORDER BY tag_code, lemma))
    SELECT locale, key, CASE WHEN coalesce(max(best), -1) <= max(first_priority) THEN max(first_code)
           ELSE arg_min(tag_code, CASE WHEN is_canonical AND priority = best THEN (tag_code, lemma) END) END AS code
    FROM m GROUP BY 1, 2
""")
def jn17_alias_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code for each (language, lemma) in the closed form of an ordered fold: the first
    row's unless a canonical row has a higher priority, then the earliest such row's."""
    n = F.col("n") % 4
    a = views.tag_aliases(spark, sf_dir).withColumns({"priority": F.when(n == 0, 3).when(n == 1, 2).when(n == 2, 1).otherwise(0), "key": F.left("lemma", F.lit(6)), "at": F.struct("tag_code", "lemma")})
    canonical = F.when(F.col("is_canonical"), F.struct(F.col("priority").alias("p"), F.col("at")))
    # The earliest row among the canonical ones of highest priority: order by priority, then reversed place.
    groups = a.groupBy("locale", "key").agg(
        F.min_by(F.struct("priority", "tag_code"), "at").alias("first"),
        F.collect_list(canonical).alias("canonical"),
    )
    top = F.array_max(F.transform("canonical", lambda x: x["p"]))
    best = F.array_min(F.filter("canonical", lambda x: x["p"] == F.col("top")))
    code = F.when(F.coalesce("top", F.lit(-1)) <= F.col("first.priority"), F.col("first.tag_code")).otherwise(best["at"]["tag_code"])
    return groups.withColumn("top", top).select("locale", "key", code.alias("code"))


@query("""
    WITH canon AS (SELECT tag_code, locale, min(lemma) AS canonical FROM tag_aliases WHERE is_canonical GROUP BY 1, 2),
    asked AS (SELECT DISTINCT upper(lemma) AS word FROM tag_aliases)
    SELECT a.word, t.tag_code, t.locale, c.canonical, row_number() OVER (PARTITION BY a.word ORDER BY t.is_canonical DESC, t.n DESC, t.tag_code, t.locale) AS rank
    FROM asked a JOIN tag_aliases t ON lower(a.word) = lower(t.lemma) LEFT JOIN canon c ON c.tag_code = t.tag_code AND c.locale = t.locale
""")
def jn5_inspect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a word, case-insensitively, with their canonical lemma, best first."""
    t = views.tag_aliases(spark, sf_dir)
    canon = t.where("is_canonical").groupBy("tag_code", "locale").agg(F.min("lemma").alias("canonical"))
    asked = t.select(F.upper("lemma").alias("word")).distinct().withColumn("low", F.lower("word"))
    found = asked.join(t.withColumn("low", F.lower("lemma")), "low").join(canon, ["tag_code", "locale"], "left")
    rank = Window.partitionBy("word").orderBy(F.desc("is_canonical"), F.desc("n"), "tag_code", "locale")
    return found.select("word", "tag_code", "locale", "canonical", F.row_number().over(rank).alias("rank"))


@query("""
    WITH w AS (SELECT word FROM words)
    SELECT word, CASE WHEN regexp_matches(word, '[^a-zà-ÿ]') OR regexp_matches(word, '[÷]') THEN 'R01'
        WHEN regexp_matches(word, '^[0-9a-f]{4,}$') AND length(word) IN (8, 16, 32, 40, 64) THEN 'R04'
        WHEN word IN ('the','and','of','to','der','die','und','les','des','que','los','las','una') THEN 'R05'
        WHEN word IN ('null','none','unknown','undefined','other') THEN 'R09' ELSE 'ok' END AS verdict FROM w
""")
def str16_tag_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.words(spark, sf_dir).select("word", T.tag_verdict(F.col("word"), STOPWORDS, RESERVED, FRAMES).alias("verdict"))


@query("""
    SELECT verdict, sum(n)::BIGINT AS tags FROM (
        SELECT CASE WHEN word IN ('the','and','of','to','der','die','und','les','des','que','los','las','una') THEN 'R05'
               WHEN regexp_matches(word, '[÷]') THEN 'R01'
               WHEN regexp_matches(word, '^[0-9a-f]{4,}$') AND length(word) IN (8, 16, 32, 40, 64) THEN 'R04'
               WHEN word IN ('null','none','unknown','undefined','other') THEN 'R09' ELSE 'ok' END AS verdict, 1 AS n FROM tokens)
    GROUP BY 1
""")
def agg15_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by rule; each distinct word is judged once."""
    counted = views.tokens(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(T.tag_verdict(F.col("word"), STOPWORDS, RESERVED, FRAMES).alias("verdict"), "n").groupBy("verdict").agg(F.sum("n").alias("tags"))


@query("""
    SELECT tag, CASE WHEN tag IN ('日本語', '人', '好吗') THEN 'zh' WHEN tag = 'フォルダ' THEN 'ja' WHEN tag IN ('счёт', 'latинский', 'lat инский', 'тест-test') THEN 'ru' ELSE 'en' END AS language
    FROM (VALUES ('report'), ('счёт'), ('日本語'), ('人'), ('フォルダ'), ('latинский'), ('lat инский'), ('тест-test'), ('好吗'), ('é')) t(tag)
""")
def str11_tag_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([(t,) for t in ("report", "счёт", "日本語", "人", "フォルダ", "latинский", "lat инский", "тест-test", "好吗", "é")], "tag string")
    return tags.select("tag", T.tag_language(F.col("tag")).alias("language"))


@query("""
    WITH pairs AS (SELECT DISTINCT lemma, tag_code FROM tag_aliases)
    SELECT conv_id, turn, list_sort(list_distinct(list(p.tag_code))) AS codes
    FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) c
    JOIN pairs p ON lower(split_part(p.lemma, ' ', 1)) = c.w GROUP BY 1, 2
""")
def set2_normalised_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags to codes: dropped if unknown, sorted, each once."""
    pairs = views.tag_aliases(spark, sf_dir).select(F.lower(F.split_part("lemma", F.lit(" "), F.lit(1))).alias("w"), "tag_code").distinct()
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("w"))
    return rows.join(pairs, "w").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("tag_code")).alias("codes"))


@query("SELECT DISTINCT least(l_returnflag, l_linestatus) AS a, greatest(l_returnflag, l_linestatus) AS b FROM lineitem WHERE l_returnflag <> l_linestatus")
def set4_pair_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs without self-pairs."""
    line = views.table(spark, sf_dir, "lineitem").where("l_returnflag <> l_linestatus")
    return line.select(F.least("l_returnflag", "l_linestatus").alias("a"), F.greatest("l_returnflag", "l_linestatus").alias("b")).distinct()


@query("""
    WITH l AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN lang || '_yy' ELSE 'x' || lang END AS locale FROM documents
               UNION SELECT unnest(['zh-CN', 'ZH', 'ja_JP', 'pt-BR', '']))
    SELECT locale, CASE WHEN left(lower(locale), 2) IN ('zh', 'ja', 'fr', 'de', 'es') THEN left(lower(locale), 2) ELSE 'en' END AS language FROM l
""")
def str10_locale_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that a locale begins with, English for all others."""
    key = F.col("doc_id") % 4
    locale = F.when(key == 0, F.col("lang")).when(key == 1, F.concat(F.upper("lang"), F.lit("-XX"))).when(key == 2, F.concat("lang", F.lit("_yy"))).otherwise(F.concat(F.lit("x"), "lang"))
    given = spark.createDataFrame([(x,) for x in ("zh-CN", "ZH", "ja_JP", "pt-BR", "")], "locale string")
    rows = views.table(spark, sf_dir, "documents").select(locale.alias("locale")).union(given).distinct()
    low, out = F.lower("locale"), F.lit("en")
    for lang in ("zh", "ja", "fr", "de", "es"):
        out = F.when(low.startswith(lang), lang).otherwise(out)
    return rows.select("locale", out.alias("language"))
