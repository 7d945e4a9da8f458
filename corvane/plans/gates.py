"""Gates, defaults and small decisions about tags, requests and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.search import top_k
from ..operators.similar import near_classes
from ..sources import views
from .base import ORACLE, query
from .search import asked_vectors, stored
from .texts import languages

_list = lambda values: ", ".join(f"'{v}'" for v in values)

# Codes of the leaves of the sensitive dimensions that compliance gates act on (fixed values).
SENSITIVE = """
builtin.violence_terrorism builtin.political_issues omw.00746116.n omw.00747215.n omw.00419908.n omw.00247439.a
builtin.soft_porn builtin.semi_explicit builtin.fully_explicit builtin.special_xp builtin.extreme_grotesque
builtin.beheading builtin.dismemberment_and_dismantling_of_a_corpse builtin.bloody_massacre builtin.corpse_remains builtin.torture hownet.000000250538.a
builtin.hardcore_grotesque builtin.terror_tragedy builtin.self_harm_bleeding
builtin.anti_party_and_anti_government hownet.000000292078.n builtin.secession omw.00759694.n builtin.cult_organizations builtin.riots_and_unrest
builtin.religious_extremism builtin.extremist_ideologies
builtin.drug_trafficking hownet.000000263362.v builtin.firearms_and_ammunition builtin.money_laundering_and_illegal_activities hownet.000000207620.n
builtin.dark_web_transactions builtin.online_gambling omw.01908539.s builtin.abuse_of_minors hownet.000000270144.n
builtin.family_incest builtin.extramarital_lust builtin.teacher_student_erotica builtin.workplace_erotica builtin.group_sex builtin.sex_training
builtin.peeping_wardrobe_malfunction builtin.uniform_seduction builtin.erotic_literature builtin.erotic_physiology builtin.involuntary_assault
builtin.diverse_sexual_orientations
""".split()
#: Tags of a file by the engine that found them.
COLLECTIONS = ("clip", "ram", "ocr", "text", "rating", "fused")
# Prefixes of parents of which a file takes one tag (fixed values).
ONE_OF_PREFIXES = """
builtin.tu_pian_xi_fen. builtin.sheying_zhaopian. builtin.jietu. builtin.hetong_piaoju. builtin.zhengzhao. builtin.shi_pai. builtin.te_xie. builtin.ri_guang.
builtin.tou_ming_bei_jing. builtin.ping_shi. builtin.chun_wen_zi. builtin.windows_jietu. builtin.heng_bing. builtin.dan_ren. builtin.wei_liang_wen_ben.
builtin.manhua. builtin.quan_nian_ling. builtin.wu_ma. builtin.wu_shuiyin. builtin.gaozhiliang. builtin.guang_liang_hao. builtin.xue_xing. builtin.she_zheng.
builtin.wei_gui. builtin.se_qing.
""".split()
# Platforms by program format (fixed values).
PLATFORMS = {"PE": "windows", "ELF": "linux", "Mach-O": "macos"}


def is_sensitive(code) -> F.Column:
    return F.coalesce(F.trim(code).isin(SENSITIVE), F.lit(False))


MARKED = f"""
    t AS (SELECT file, ordinal, ([{_list(COLLECTIONS)}])[1 + ordinal % 6] AS collection,
                 CASE WHEN (file + ordinal) % 7 < 3 THEN ' ' || ([{_list(SENSITIVE)}])[1 + (file * 3 + ordinal) % {len(SENSITIVE)}] ELSE code END AS code FROM scored_tags)
"""


def marked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.scored_tags(spark, sf_dir)
    place = ((F.col("file") * 3 + F.col("ordinal")) % len(SENSITIVE)).cast("int")
    code = F.when((F.col("file") + F.col("ordinal")) % 7 < 3, F.concat(F.lit(" "), F.get(F.array(*map(F.lit, SENSITIVE)), place))).otherwise(F.col("code"))
    return t.select("file", "ordinal", F.get(F.array(*map(F.lit, COLLECTIONS)), (F.col("ordinal") % 6).cast("int")).alias("collection"), code.alias("code"))


@query(f"WITH {MARKED} SELECT file, ordinal, code, trim(code) IN ({_list(SENSITIVE)}) AS sensitive FROM t")
def flt16_sensitive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_tags(spark, sf_dir).select("file", "ordinal", "code", is_sensitive(F.col("code")).alias("sensitive"))


@query(f"WITH {MARKED} SELECT file, collection, list(code ORDER BY ordinal) AS codes FROM t WHERE file % 2 = 1 OR trim(code) NOT IN ({_list(SENSITIVE)}) GROUP BY 1, 2")
def flt17_sensitive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive tags go from all six collections of files for all ages (here: even ones)."""
    t = marked_tags(spark, sf_dir).where((F.col("file") % 2 == 1) | ~is_sensitive(F.col("code")))
    lists = F.array_sort(F.collect_list(F.struct("ordinal", "code")))  # the tags of one file
    return t.groupBy("file", "collection").agg(F.transform(lists, lambda x: x["code"]).alias("codes"))


@query("SELECT doc_id, array_to_string(list_filter(['poster', 'screenshot', source], lambda x: strlen(coalesce(text, '')) >= 400 OR x NOT IN ('poster', 'screenshot')), ' ') AS tags FROM documents")
def flt23_tags_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posters and screenshots need text to be seen (here: 400 bytes)."""
    tags = F.array(F.lit("poster"), F.lit("screenshot"), F.col("source"))
    seen = F.octet_length(F.coalesce("text", F.lit(""))) >= 400
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(tags, lambda x: seen | ~x.isin("poster", "screenshot")), " ").alias("tags"))


@query("""
    WITH r AS (SELECT file, ordinal, code, dim, CASE file % 3 WHEN 0 THEN ' builtin.A , builtin.R,,' WHEN 1 THEN '' END AS codes, CASE WHEN file % 4 < 3 THEN 'F, X' END AS dims FROM scored_tags),
    p AS (SELECT *, list_filter(list_transform(string_split(coalesce(codes, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS cs, list_filter(list_transform(string_split(coalesce(dims, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS ds FROM r)
    SELECT file, ordinal, code FROM p WHERE CASE WHEN len(cs) > 0 THEN list_contains(cs, code) WHEN len(ds) > 0 THEN list_contains(ds, dim) ELSE TRUE END
""")
def flt6_csv_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists given as text: codes come before sources, empty parts do not count, no list lets all pass."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    t = views.scored_tags(spark, sf_dir)
    codes = parts(F.when(F.col("file") % 3 == 0, " builtin.A , builtin.R,,").when(F.col("file") % 3 == 1, ""))
    dims = parts(F.when(F.col("file") % 4 < 3, "F, X"))
    rows = t.withColumns({"cs": codes, "ds": dims})
    passes = F.when(F.size("cs") > 0, F.array_contains("cs", F.col("code"))).when(F.size("ds") > 0, F.array_contains("ds", F.col("dim"))).otherwise(True)
    return rows.where(passes).select("file", "ordinal", "code")


@query("SELECT code, name, source FROM (SELECT code, name, CASE left(code, 1) WHEN 'r' THEN 'dimension' WHEN 'n' THEN 'tag' ELSE 'user' END AS source FROM tag_nodes) WHERE source IN ('dimension', 'tag', 'builtin')")
def flt8_node_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.left("code", F.lit(1))
    nodes = views.tag_nodes(spark, sf_dir).select("code", "name", F.when(first == "r", "dimension").when(first == "n", "tag").otherwise("user").alias("source"))
    return nodes.where(F.col("source").isin("dimension", "tag", "builtin"))


@query(f"""
    WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ([{_list(ONE_OF_PREFIXES)}])[1 + c_custkey % 25] || CASE WHEN c_custkey % 5 = 2 THEN 'ab12' ELSE '' END END AS parent FROM customer),
    m AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'x' || parent ELSE parent END AS parent FROM r)
    SELECT c_custkey, parent, parent IS NULL OR NOT list_bool_or(list_transform([{_list(ONE_OF_PREFIXES)}], lambda p: starts_with(trim(parent), p))) AS multi FROM m
""".replace("list_bool_or(", "list_aggregate(").replace("lambda p: starts_with(trim(parent), p)))", "lambda p: starts_with(trim(parent), p)), 'bool_or')"))
def tre20_parent_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent takes several tags unless it begins with a listed prefix; none takes several."""
    key = F.col("c_custkey")
    prefix = F.get(F.array(*map(F.lit, ONE_OF_PREFIXES)), (key % 25).cast("int"))
    parent = F.when(key % 5 == 1, " ").when(key % 5 == 2, F.concat(prefix, F.lit("ab12"))).when(key % 5 == 3, prefix).when(key % 5 == 4, F.concat(F.lit("x"), prefix))
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", parent.alias("parent"))
    one = F.exists(F.array(*map(F.lit, ONE_OF_PREFIXES)), lambda p: F.trim("parent").startswith(p))
    return rows.select("c_custkey", "parent", (F.col("parent").isNull() | ~one).alias("multi"))


@query("""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"policies": [{"code": "a", "threshold": 0.7}, {"code": "b"}]}' WHEN 1 THEN 'no json' WHEN 2 THEN NULL ELSE '{"policies": []}' END AS config FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 0 END AS loaded FROM r
""")
def src15_policy_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many policies a stored configuration gives; what cannot be read gives none."""
    key = F.col("o_orderkey") % 4
    config = F.when(key == 0, '{"policies": [{"code": "a", "threshold": 0.7}, {"code": "b"}]}').when(key == 1, "no json").when(key == 3, '{"policies": []}')
    read = F.from_json(config, "policies array<struct<code: string, threshold: double>>")["policies"]
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.when(read.isNull(), 0).otherwise(F.size(read)).alias("loaded"))


@query("""
    WITH c AS (SELECT conv_id, turn, '{"max_han": ' || turn || ', "stop": ["' || role || '"], "strict": ' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE '"yes"' END || CASE WHEN turn % 3 = 0 THEN '' ELSE '}' END AS config, role FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 10 ELSE turn END AS max_han, CASE WHEN turn % 3 = 0 THEN 'the' ELSE role END AS stop, CASE WHEN turn % 3 <> 0 AND turn % 2 = 0 THEN TRUE ELSE FALSE END AS strict, 4 AS max_words FROM c
""")
def jsn4_rule_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of rules: each field that is missing or of another kind falls back to its own default."""
    c = views.table(spark, sf_dir, "conversations")
    k = F.col("turn")
    text = F.concat(F.lit('{"max_han": '), k, F.lit(', "stop": ["'), "role", F.lit('"], "strict": '), F.when(k % 2 == 0, "true").otherwise('"yes"'), F.when(k % 3 == 0, "").otherwise("}"))
    rows = c.select("conv_id", "turn", text.alias("t"))
    valid = F.col("t").endswith("}")
    field = lambda name: F.when(valid, F.get_json_object("t", f"$.{name}"))
    stop = F.get(F.from_json(field("stop"), "array<string>"), F.lit(0))
    strict = field("strict").isin("true", "false") & (field("strict") == "true")
    return rows.select("conv_id", "turn", F.coalesce(F.try_to_number(field("max_han"), F.lit("999")).cast("int"), F.lit(10)).alias("max_han"), F.coalesce(stop, F.lit("the")).alias("stop"), F.coalesce(strict, F.lit(False)).alias("strict"), F.coalesce(field("max_words").cast("int"), F.lit(4)).alias("max_words"))


@query("""
    WITH r AS (SELECT user_id, value, 0.05 AS floor, 0.55 AS slope, 0.98 AS cap FROM events)
    SELECT user_id, count(*) AS n, round(sum(CASE WHEN value / 100 < floor THEN 0 ELSE least(cap, slope + (1 - slope) * (value / 100 - floor) / (1 - floor)) END), 4) AS total FROM r GROUP BY 1
""")
def mth8_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw similarities as confidences: nothing below the floor, from the slope's start on upwards, never above the cap."""
    raw, floor, slope, cap = F.col("value") / 100, 0.05, 0.55, 0.98
    calibrated = F.when(raw < floor, 0.0).otherwise(F.least(F.lit(cap), slope + (1 - slope) * (raw - floor) / (1 - floor)))
    return views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(calibrated), 4).alias("total"))


BINARIES = """
    b AS (SELECT p_partkey AS id, ([ 'PE', 'ELF', 'Mach-O', 'JAR'])[1 + p_partkey % 4] AS format, CASE WHEN p_partkey % 3 = 0 THEN 'builtin.fw_' || p_size % 4 END AS framework, ['builtin.cap_' || p_size % 5, 'builtin.cap_' || p_size % 3] AS caps,
                 ([NULL, 'builtin.development_tools', 'builtin.office', 'builtin.games', 'builtin.unlisted'])[1 + p_size % 5] AS category, round(p_retailprice / 3000, 4) AS score FROM part)
"""
IMPLIED = {"builtin.development_tools": "builtin.tools", "builtin.office": "builtin.tools", "builtin.games": "builtin.entertainment"}


@query(f"""
    WITH {BINARIES}, c AS (SELECT id, coalesce(category, 'builtin.development_tools') AS category, score FROM b),
    i AS (SELECT id, CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IMPLIED.items())} END AS purpose, score FROM c)
    SELECT id, CASE format WHEN 'PE' THEN 'builtin.windows' WHEN 'ELF' THEN 'builtin.linux' ELSE 'builtin.macos' END AS code, 'builtin.operating_platform' AS parent, 1.0 AS confidence FROM b WHERE format IN ('PE', 'ELF', 'Mach-O')
    UNION ALL SELECT id, framework, 'builtin.runtime_framework', 0.95 FROM b WHERE framework IS NOT NULL
    UNION ALL SELECT DISTINCT id, unnest(caps), 'builtin.program_ability_characteristics', 0.9 FROM b
    UNION ALL SELECT id, category, 'builtin.program_segmentation', score FROM c
    UNION ALL SELECT id, purpose, 'builtin.file_purpose', score FROM i WHERE purpose IS NOT NULL
""")
def arb11_binary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a program: platform, framework, abilities, category (development tools without one) and the purpose that it implies."""
    part = views.table(spark, sf_dir, "part")
    size = F.col("p_size")
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    b = part.select(F.col("p_partkey").alias("id"), at(["PE", "ELF", "Mach-O", "JAR"], F.col("p_partkey") % 4).alias("format"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("builtin.fw_"), size % 4)).alias("framework"),
                    F.array_distinct(F.array(F.concat(F.lit("builtin.cap_"), size % 5), F.concat(F.lit("builtin.cap_"), size % 3))).alias("caps"),
                    F.coalesce(at([None, "builtin.development_tools", "builtin.office", "builtin.games", "builtin.unlisted"], size % 5), F.lit("builtin.development_tools")).alias("category"), F.round(F.col("p_retailprice") / 3000, 4).alias("score"))
    named = F.create_map(*[F.lit(x) for k, v in PLATFORMS.items() for x in (k, f"builtin.{v}")])
    implied = F.create_map(*[F.lit(x) for kv in IMPLIED.items() for x in kv])
    tag = lambda code, parent, confidence: F.struct(code.alias("code"), F.lit(parent).alias("parent"), confidence.cast("double").alias("confidence"))
    tags = F.concat(
        F.array(tag(F.try_element_at(named, F.col("format")), "builtin.operating_platform", F.lit(1.0)), tag(F.col("framework"), "builtin.runtime_framework", F.lit(0.95)), tag(F.col("category"), "builtin.program_segmentation", F.col("score")), tag(F.try_element_at(implied, F.col("category")), "builtin.file_purpose", F.col("score"))),
        F.transform("caps", lambda c: tag(c, "builtin.program_ability_characteristics", F.lit(0.9))),
    )
    return b.select("id", F.explode(F.filter(tags, lambda t: t["code"].isNotNull())).alias("t")).select("id", "t.code", "t.parent", "t.confidence")


@query("""
    WITH g AS (SELECT file, ordinal, code, dim, confidence, (['clip', 'ram', 'ocr'])[1 + ordinal % 3] AS engine FROM scored_tags),
    k AS (SELECT *, row_number() OVER (PARTITION BY file, engine, dim ORDER BY confidence DESC, ordinal) AS n FROM g WHERE NOT (engine = 'ocr' AND dim = 'O'))
    SELECT file, ordinal, engine, code FROM k WHERE engine <> 'clip' OR n = 1
""")
def arb7_engine_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines speak only for their domains; of an engine of exclusive groups the best tag of each group stays."""
    engine = F.get(F.array(F.lit("clip"), F.lit("ram"), F.lit("ocr")), (F.col("ordinal") % 3).cast("int"))
    g = views.scored_tags(spark, sf_dir).withColumn("engine", engine).where(~((F.col("engine") == "ocr") & (F.col("dim") == "O")))
    order = Window.partitionBy("file", "engine", "dim").orderBy(F.desc("confidence"), "ordinal")
    return g.withColumn("n", F.row_number().over(order)).where((F.col("engine") != "clip") | (F.col("n") == 1)).select("file", "ordinal", "engine", "code")


@query("""
    WITH h AS (SELECT file, code, count(DISTINCT dim) AS sources, max(confidence) AS best, 1 - exp(sum(ln(greatest(1 - least(0.99, greatest(confidence, 0)), 0.01)))) AS belief FROM scored_tags GROUP BY 1, 2)
    SELECT file, code, sources, round(belief, 6) AS belief, sources >= 2 OR best >= 0.9 AS accepted FROM h
""")
def arb10_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for a tag joined as independent: belief is one minus the product of the doubts; accepted from two sources or one strong one.
    The logarithms are summed in the order of the tags, so that no belief hangs on how rows were dealt; as none is
    positive, the last of the running sums is the least. Halves are told on the scaled double, as the SQL does."""
    doubt = F.greatest(1 - F.least(F.lit(0.99), F.greatest(F.col("confidence"), F.lit(0.0))), F.lit(0.01))
    so_far = Window.partitionBy("file", "code").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = views.scored_tags(spark, sf_dir).withColumn("logs", F.sum(F.log(doubt)).over(so_far))
    h = t.groupBy("file", "code").agg(F.count_distinct("dim").alias("sources"), F.max("confidence").alias("best"), (1 - F.exp(F.min("logs"))).alias("belief"))
    return h.select("file", "code", "sources", (F.round(F.col("belief") * 1e6) / 1e6).alias("belief"), ((F.col("sources") >= 2) | (F.col("best") >= 0.9)).alias("accepted"))


@query(f"""
    WITH l AS ({{detected}}), d AS (SELECT doc_id, lang, doc_id % 3 AS kind FROM documents)
    SELECT d.doc_id, CASE kind WHEN 0 THEN NULL WHEN 1 THEN coalesce(CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' END, l.language) ELSE l.language END AS language FROM d LEFT JOIN l USING (doc_id)
""".format(detected=ORACLE["str12_document_language"]))
def txt15_fact_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures have no language, recordings that of their metadata if it is known, else what the text shows."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = docs.select("doc_id", "lang").join(languages(docs.select("doc_id", "text")), "doc_id", "left")
    kind = F.col("doc_id") % 3
    stated = F.when(F.col("lang").isin("en", "de"), F.col("lang"))
    return found.select("doc_id", F.when(kind == 1, F.coalesce(stated, "language")).when(kind == 2, F.col("language")).alias("language"))


@query("""
    WITH s AS (SELECT o_orderkey, c_name AS who, n_name AS place, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS what, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderstatus END AS why FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT o_orderkey, array_to_string(list_filter(['who: ' || who, 'where: ' || place, CASE WHEN trim(coalesce(what, '')) <> '' THEN 'what: ' || what END, CASE WHEN trim(why) <> '' THEN 'why: ' || why END], lambda x: x IS NOT NULL), '; ') AS summary,
           left(trim(regexp_replace(array_to_string(list_filter([CASE WHEN trim(coalesce(what, '')) <> '' THEN what END, who, place], lambda x: x IS NOT NULL)[1:2], ' '), '[^A-Za-z0-9]+', '_', 'g'), '_'), 24) AS name FROM s
""")
def txt13_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that say something as one line, and a file name of the first two of what, who and where."""
    o, c, n = (views.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = rows.select("o_orderkey", F.col("c_name").alias("who"), F.col("n_name").alias("place"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("what"), F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("why"))
    said = lambda c: F.when(F.trim(c) != "", F.col(c))
    summary = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{label}: "), said(c)) for label, c in (("who", "who"), ("where", "place"), ("what", "what"), ("why", "why"))])), "; ")
    name = F.array_join(F.slice(F.array_compact(F.array(said("what"), said("who"), said("place"))), 1, 2), " ")
    return rows.select("o_orderkey", summary.alias("summary"), F.left(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit(24)).alias("name"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, label, 'v' || vec_id AS fp, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q WHERE vec_id % 50 <> 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fp) AS k FROM s)
    SELECT query_id, CASE WHEN score >= 0.35 THEN 'label' || label ELSE 'builtin.content_tags' END AS parent, CASE WHEN score >= 0.35 THEN 2 ELSE 1 END AS depth, CASE WHEN score >= 0.35 THEN score ELSE 0.0 END AS confidence FROM b WHERE k = 1
""")
def txt14_resolved_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of the nearest known tag if it is near enough, else the content root."""
    rows = stored(spark, sf_dir)
    near = top_k(rows.where("vec_id % 50 <> 0"), asked_vectors(rows), 1, keep=["label"])
    ok = F.col("score") >= 0.35
    return near.select("query_id", F.when(ok, F.concat(F.lit("label"), "label")).otherwise("builtin.content_tags").alias("parent"), F.when(ok, 2).otherwise(1).alias("depth"), F.when(ok, F.col("score")).otherwise(0.0).alias("confidence"))


@query("""
    WITH l AS (SELECT tag_code AS code, list_sort(list_distinct(list(lemma) FILTER (locale = 'en'))) AS en, list_sort(list_distinct(list(lemma) FILTER (locale = 'fr'))) AS fr FROM tag_aliases GROUP BY 1),
    pairs AS (SELECT DISTINCT 'builtin.brand_' || (p_size % 25 + 1) AS a, 'builtin.brand_' || ((p_size + 7) % 25 + 1) AS b FROM part),
    o AS (SELECT a AS code, b AS other FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b)
    SELECT l.code, array_to_string(coalesce(en, []), '|') AS synonyms, array_to_string(coalesce(fr, []), '|') AS aligned, coalesce((SELECT string_agg(other, '|' ORDER BY other) FROM o WHERE o.code = l.code), '') AS antonyms FROM l
""")
def txt16_lexicon_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms of a code, its words in another language, and its opposites both ways."""
    t = views.tag_aliases(spark, sf_dir)
    words = lambda x: F.array_join(F.array_sort(F.collect_set(F.when(F.col("locale") == x, F.col("lemma")))), "|")
    entries = t.groupBy(F.col("tag_code").alias("code")).agg(words("en").alias("synonyms"), words("fr").alias("aligned"))
    brand = lambda k: F.concat(F.lit("builtin.brand_"), (k % 25 + 1).cast("string"))
    pairs = views.table(spark, sf_dir, "part").select(brand(F.col("p_size")).alias("code"), brand(F.col("p_size") + 7).alias("other")).where("code <> other").distinct()
    both = pairs.union(pairs.select("other", "code")).distinct().groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("other")), "|").alias("antonyms"))
    return entries.join(both, "code", "left").select("code", "synonyms", "aligned", F.coalesce("antonyms", F.lit("")).alias("antonyms"))


@query("""
    WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS sentence, unnest(range(1, len(string_split(coalesce(text, ''), '. ')) + 1)) AS place FROM documents),
    c AS (SELECT doc_id, place, length(trim(sentence)) AS n, len(list_distinct(regexp_extract_all(lower(sentence), '[a-zà-ÿ]{5,}'))) AS words FROM s WHERE length(trim(sentence)) BETWEEN 20 AND 300),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, place) AS rank FROM c)
    SELECT doc_id, place, words, rank FROM r WHERE rank <= 3
""")
def rnk9_key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of middling length with most different long words, the first of equals."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\. ")).alias("place", "sentence"))
    n = F.char_length(F.trim("sentence"))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit("([a-zà-ÿ]{5,})")))).cast("long")
    rows = docs.where(n.between(20, 300)).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), words.alias("words"))
    best = rows.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("w"), "place"))), 1, 3).alias("t"))
    return best.select("doc_id", F.posexplode("t").alias("k", "t")).select("doc_id", "t.place", (-F.col("t.w")).alias("words"), (F.col("k") + 1).cast("long").alias("rank"))


@query("""
    WITH r AS (SELECT label, count(*) FILTER (vec_id % 3 <> 0) AS valid, count(*) AS given FROM embeddings WHERE label <> 4 OR vec_id % 3 = 0 GROUP BY 1)
    SELECT label, given, valid, CASE WHEN given > 0 AND valid < 2 THEN 'too few documents' END AS problem FROM r
""")
def clu3_too_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustering request with documents needs two that have a vector."""
    e = views.table(spark, sf_dir, "embeddings").where("label <> 4 OR vec_id % 3 = 0")
    v = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    r = e.groupBy("label").agg(F.count(F.lit(1)).alias("given"), F.count(F.when(V.fit(v, 64).isNotNull(), 1)).alias("valid"))
    return r.select("label", "given", "valid", F.when((F.col("given") > 0) & (F.col("valid") < 2), "too few documents").alias("problem"))


@query("""
    WITH RECURSIVE h AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (CAST(p_size AS BIGINT) << 20) + (p_partkey % 4) END AS bits FROM part),
    e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON bit_count(xor(a.bits, b.bits)) <= 1),
    r AS (SELECT id, id AS root FROM h UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
    SELECT id, min(root) AS class_id FROM r GROUP BY 1
""")
def dup2_image_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of pictures by the hash that comes with them; without one a picture stands alone."""
    part = views.table(spark, sf_dir, "part")
    bits = F.when(F.col("p_partkey") % 11 != 0, F.shiftleft(F.col("p_size").cast("long"), 20) + F.col("p_partkey") % 4)
    return near_classes(part.select(F.col("p_partkey").alias("id"), bits.alias("bits")), 1)


@query("""
    WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 4.0 + conv_id % 5 ELSE 20.0 END AS seconds, (conv_id * 7 + turn) % 5 AS track FROM conversations),
    g AS (SELECT track, CAST(round(seconds) AS BIGINT) AS length, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM t GROUP BY 1, 2)
    SELECT track, length, n, first FROM g WHERE n > 1
""")
def dup3_recording_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of one content key and, to the second, one length, from columns that come with them."""
    c = views.table(spark, sf_dir, "conversations")
    seconds = F.when(F.col("turn") % 2 == 0, 4.0 + F.col("conv_id") % 5).otherwise(20.0)
    rows = c.select(((F.col("conv_id") * 7 + F.col("turn")) % 5).alias("track"), F.round(seconds).cast("long").alias("length"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return rows.groupBy("track", "length").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


@query("""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"size": "small", "items": ' || (o_orderkey % 9 - 2) || ', "safe": true}' WHEN 1 THEN '{"size": "huge"}' ELSE 'broken' END AS request FROM orders),
    p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'small' ELSE 'tiny' END AS size, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 - 2 >= -1 THEN o_orderkey % 9 - 2 ELSE 100 END AS items FROM r)
    SELECT o_orderkey, size, items, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS safe, '{"items":' || items || ',"size":"' || size || '"}' AS saved FROM p
""")
def src14_config_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration read over defaults, each field checked by itself, flags joined by and, and saved again."""
    key = F.col("o_orderkey")
    request = F.when(key % 3 == 0, F.concat(F.lit('{"size": "small", "items": '), key % 9 - 2, F.lit(', "safe": true}'))).when(key % 3 == 1, '{"size": "huge"}').otherwise("broken")
    given = F.from_json(request, "size string, items int, safe boolean")
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", given.alias("g"))
    size = F.when(F.col("g.size").isin("tiny", "small"), F.col("g.size")).otherwise("tiny")
    items = F.when(F.col("g.items") >= -1, F.col("g.items")).otherwise(100)
    safe = F.coalesce(F.col("g.safe"), F.lit(False)) & (F.col("o_orderkey") % 2 == 0)
    return rows.select("o_orderkey", size.alias("size"), items.alias("items"), safe.alias("safe"), F.to_json(F.struct(items.alias("items"), size.alias("size"))).alias("saved"))
