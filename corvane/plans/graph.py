"""Concept graphs: ancestry, lexicon, antonyms, siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import ancestors
from ..sources import views
from .base import query

CLOSURE = """
    WITH RECURSIVE up AS (
        SELECT code, parent AS ancestor, 1 AS distance FROM tag_nodes WHERE parent IS NOT NULL
        UNION ALL SELECT u.code, t.parent, u.distance + 1 FROM up u JOIN tag_nodes t ON t.code = u.ancestor WHERE t.parent IS NOT NULL AND u.distance < {depth}
    )
"""


@query(CLOSURE.format(depth=5) + "SELECT code, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2")
def jn7_ancestors_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestors(views.tag_nodes(spark, sf_dir), 5)


@query(CLOSURE.format(depth=64) + "SELECT ancestor, count(DISTINCT code) AS descendants, max(distance) AS height FROM (SELECT code, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2) GROUP BY 1")
def jn8_descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = ancestors(views.tag_nodes(spark, sf_dir), 64)
    return closed.groupBy("ancestor").agg(F.count_distinct("code").alias("descendants"), F.max("distance").alias("height"))


@query(CLOSURE.format(depth=5) + """
    , chain AS (SELECT code, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2)
    SELECT c.code, list(n.name ORDER BY c.distance, c.ancestor) AS chain FROM chain c JOIN (SELECT DISTINCT code, name FROM tag_nodes) n ON n.code = c.ancestor WHERE c.code LIKE 's\\_%' ESCAPE '\\' GROUP BY 1
""")
def jn9_hypernym_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broader concepts of a concept, nearest first, each once."""
    nodes = views.tag_nodes(spark, sf_dir)
    names = nodes.select(F.col("code").alias("ancestor"), "name").distinct()
    chain = ancestors(nodes, 5).where(F.col("code").startswith("s_")).join(names, "ancestor")
    return chain.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor", "name"))), lambda x: x["name"]).alias("chain"))


@query("""
    WITH entries AS (SELECT tag_code AS synset, locale, lemma FROM tag_aliases),
    asked AS (SELECT DISTINCT lemma AS word FROM tag_aliases),
    hits AS (SELECT DISTINCT a.word, e.synset, e.locale FROM asked a JOIN entries e ON lower(e.lemma) = lower(a.word)),
    chosen AS (SELECT word, synset FROM hits h WHERE locale = 'fr' UNION SELECT word, synset FROM hits h WHERE locale = 'en' AND NOT EXISTS (SELECT 1 FROM hits f WHERE f.word = h.word AND f.locale = 'fr'))
    SELECT c.word, c.synset, list_sort(list_distinct(list(e.lemma))) AS lemmas FROM chosen c JOIN entries e ON e.synset = c.synset GROUP BY 1, 2
""")
def jn10_lexical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synsets of a word in its language, in English where it has none, with their lemmas."""
    t = views.tag_aliases(spark, sf_dir)
    asked = t.select(F.col("lemma").alias("word")).distinct()
    hits = asked.join(t.select("tag_code", "locale", F.lower("lemma").alias("low")), F.lower("word") == F.col("low")).select("word", F.col("tag_code").alias("synset"), "locale").distinct()
    own, english = hits.where("locale = 'fr'"), hits.where("locale = 'en'")
    chosen = own.unionByName(english.join(own.select("word").distinct(), "word", "left_anti")).select("word", "synset").distinct()
    lemmas = t.groupBy(F.col("tag_code").alias("synset")).agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    return chosen.join(lemmas, "synset").select("word", "synset", "lemmas")


@query("""
    WITH sense AS (SELECT DISTINCT p_brand AS word, p_type AS opposite FROM part WHERE p_size < 3),
    pairs AS (SELECT DISTINCT p_brand AS word, p_name AS opposite FROM part WHERE p_size < 9)
    SELECT word, opposite, 'sense' AS origin FROM sense UNION ALL SELECT word, opposite, 'pair' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM sense s WHERE s.word = p.word)
""")
def jn11_antonym_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sense relations; the pair table only for words that have none."""
    part = views.table(spark, sf_dir, "part")
    sense = part.where("p_size < 3").select(F.col("p_brand").alias("word"), F.col("p_type").alias("opposite")).distinct()
    pairs = part.where("p_size < 9").select(F.col("p_brand").alias("word"), F.col("p_name").alias("opposite")).distinct()
    return sense.withColumn("origin", F.lit("sense")).unionByName(pairs.join(sense.select("word").distinct(), "word", "left_anti").withColumn("origin", F.lit("pair")))


@query("SELECT DISTINCT a.code, b.code AS sibling FROM tag_nodes a JOIN tag_nodes b ON a.parent = b.parent AND a.code <> b.code")
def jn12_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that share a parent."""
    n = views.tag_nodes(spark, sf_dir).select("code", "parent")
    return n.join(n.withColumnRenamed("code", "sibling"), "parent").where("code <> sibling").select("code", "sibling").distinct()


@query("""
    WITH used AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey % 9 = 0)
    SELECT r_name AS top, count(*) AS unmapped FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT k FROM used) GROUP BY 1
""")
def jn14_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that no tag refers to, counted by their top ancestor."""
    used = views.table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    nation, region = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    free = nation.join(used, "n_nationkey", "left_anti").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return free.groupBy(F.col("r_name").alias("top")).agg(F.count(F.lit(1)).alias("unmapped"))


@query("""
    WITH c AS (SELECT n_name, lat, lng, c_custkey, clat, clng FROM (
        SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN 95.0 ELSE (n_nationkey * 6.5 - 80) + (c_custkey % 7) * 0.2 END AS clat, (n_nationkey * 13.0 - 160) + (c_custkey % 5) * 0.2 AS clng FROM customer JOIN nation ON c_nationkey = n_nationkey) q,
        (SELECT n_name, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.0 - 160 AS lng FROM nation) p),
    d AS (SELECT c_custkey, n_name, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))) AS km FROM c),
    nearest AS (SELECT c_custkey, arg_min(n_name, (km, n_name)) AS place, min(km) AS km FROM d GROUP BY 1),
    best AS (SELECT c_custkey, CASE WHEN c_custkey % 37 = 0 THEN 'Site ' || c_custkey WHEN c_custkey % 31 <> 0 THEN place END AS place, CASE WHEN c_custkey % 37 = 0 THEN 0.0 WHEN c_custkey % 31 <> 0 THEN km END AS km FROM nearest)
    SELECT c_custkey, CASE WHEN km <= 500 THEN place END AS place, CASE WHEN km <= 500 THEN round(km, 3) END AS distance_km, CASE WHEN km <= 50 THEN 'city' WHEN km <= 500 THEN 'province' ELSE 'none' END AS tier FROM best
""")
def jn18_reverse_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place within 500 km, the first by name of equals: a city up to 50 km, a province beyond.
    A place stated for a point comes before all others; a point beyond the globe has none.

    Points and places meet in cells of five degrees of latitude and ten of
    longitude. A place is listed in every cell that 500 km around it can touch,
    a point in its own, so one equi-join finds all candidates and the places
    beyond reach never meet the point.
    """
    nation, customer = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "customer")
    places = nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lng"))
    points = customer.select("c_custkey", F.when(F.col("c_custkey") % 31 == 0, 95.0).otherwise(F.col("c_nationkey") * 6.5 - 80 + (F.col("c_custkey") % 7) * 0.2).alias("clat"), (F.col("c_nationkey") * 13.0 - 160 + (F.col("c_custkey") % 5) * 0.2).alias("clng"))
    stated = customer.where("c_custkey % 37 = 0").select("c_custkey", F.concat(F.lit("Site "), "c_custkey").alias("stated"))
    valid = (F.abs("clat") <= 90) & (F.abs("clng") <= 180)
    reach = 4.6  # degrees of latitude in 500 km, rounded up
    band = lambda c: F.floor((c + 90) / 5)
    cell = lambda c: F.floor((c + 180) / 10)
    # Meridians draw together towards the poles; there every cell of the band is in reach.
    edge = F.least(F.lit(89.9), F.abs("lat") + reach)
    wide = F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(edge))))) + F.when(F.abs("lat") + reach >= 89.9, 180.0).otherwise(0.0))
    listed = places.withColumn("band", F.explode(F.sequence(band(F.col("lat") - reach), band(F.col("lat") + reach))))
    listed = listed.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("lng") - wide), cell(F.col("lng") + wide)), lambda x: F.pmod(x, F.lit(36))))))
    half = F.sin(F.radians(F.col("lat") - F.col("clat")) / 2) ** 2 + F.cos(F.radians("clat")) * F.cos(F.radians("lat")) * F.sin(F.radians(F.col("lng") - F.col("clng")) / 2) ** 2
    km = 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
    best = points.withColumns({"band": F.when(valid, band(F.col("clat"))), "cell": F.pmod(cell(F.col("clng")), F.lit(36))}).join(listed, ["band", "cell"], "left").withColumn("km", km).groupBy("c_custkey").agg(F.min_by("name", F.struct("km", "name")).alias("name"), F.min("km").alias("km"))
    best = best.join(stated, "c_custkey", "left").withColumns({"name": F.coalesce("stated", "name"), "km": F.when(F.col("stated").isNotNull(), 0.0).otherwise(F.col("km"))})
    near = F.coalesce(F.col("km") <= 500, F.lit(False))
    return best.select("c_custkey", F.when(near, F.col("name")).alias("place"), F.when(near, F.round("km", 3)).alias("distance_km"), F.when(near & (F.col("km") <= 50), "city").when(near, "province").otherwise("none").alias("tier"))


@query("""
    SELECT n_regionkey, arg_max(n_name, (4 * (n_nationkey % 2) + 2 * (CASE WHEN length(n_name) > 7 THEN 1 ELSE 0 END), -n_nationkey)) AS best FROM nation GROUP BY 1
""")
def agg18_best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred names before others, long before short ones, the first of equals."""
    score = 4 * (F.col("n_nationkey") % 2) + 2 * F.when(F.char_length("n_name") > 7, 1).otherwise(0)
    return views.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.max_by("n_name", F.struct(score.alias("s"), (-F.col("n_nationkey")).alias("k"))).alias("best"))


@query("""
    SELECT r_name, count(*) AS nations, row_number() OVER (ORDER BY count(*) DESC, r_name) AS position FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def agg14_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    counts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("nations"), "r_name")))
