"""Taxonomy trees: live files rolled up along their tag paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tree import TreeRules, healed, hoisted, named_rollup, node_source, part_of_speech, prefixes, rollup, root_rank, sort_order, under_directory, valid_file
from ..operators.graph import ancestors
from ..sources import views
from ..sources.scratch import written
from .base import query

ROOT, RULES = "builtin.content_tags", TreeRules()


def live_files(files: DataFrame, workspace: int | None = None, directory: str | None = None) -> DataFrame:
    """Files of status 1, of one workspace and below one directory if asked for."""
    out = files.where("status = 1")
    if workspace is not None:
        out = out.where(F.col("workspace_id") == workspace)
    if directory is not None:
        out = out.where(under_directory(F.col("path"), directory))
    return out


def tagged_files(spark: SparkSession, sf_dir: str, **scope) -> DataFrame:
    """(id, code_path) of the live files in scope; the fact table joins the files on the
    fingerprint, paths ride along as strings that a dictionary page compresses."""
    files = live_files(views.workspace_files(spark, sf_dir), **scope)
    return views.file_tag_relations(spark, sf_dir).join(files, "file_fingerprint").select("id", "code_path")


ROLLUP = """
    WITH facts AS (
        SELECT w.id, r.code_path FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint)
        WHERE w.status = 1 {scope}
    ), split AS (
        SELECT id, code_path, string_split(substr(code_path, 2), '/') AS s FROM facts
    ), nodes AS (
        SELECT id, k AS depth, '/' || array_to_string(s[1:k], '/') AS node, s[k] AS code, k = len(s) AS leaf
        FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM split)
    )
    SELECT node AS code_path, code, depth, count(DISTINCT id) AS total_files,
           count(DISTINCT CASE WHEN leaf THEN id END) AS direct_files
    FROM nodes GROUP BY node, code, depth
"""


@query(ROLLUP.format(scope=""))
def agg2_taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files of every node, own and below, along all path prefixes."""
    return rollup(tagged_files(spark, sf_dir))


@query(ROLLUP.format(scope="AND w.workspace_id = 1 AND (w.path = '/ws/f' OR w.path LIKE '/ws/f/%')"))
def flt3_taxonomy_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(tagged_files(spark, sf_dir, workspace=1, directory="\\ws\\f\\"))


@query("SELECT workspace_id, count(*) AS files FROM workspace_files WHERE status = 1 GROUP BY 1")
def flt1_live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(views.workspace_files(spark, sf_dir)).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("files"))


@query("""
    SELECT id, file_fingerprint, id BETWEEN 0 AND 4294967295 AS counted
    FROM (SELECT CASE WHEN id % 7 = 0 THEN id + 4294967296 ELSE id END AS id,
                 CASE WHEN id % 11 = 0 THEN '  ' ELSE file_fingerprint END AS file_fingerprint FROM workspace_files)
    WHERE trim(file_fingerprint) <> ''
""")
def flt4_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.workspace_files(spark, sf_dir).select(F.when(F.col("id") % 7 == 0, F.col("id") + 4294967296).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 11 == 0, "  ").otherwise(F.col("file_fingerprint")).alias("file_fingerprint"))
    return valid_file(rows)


@query("""
    WITH one AS (SELECT r.code_path, w.id, r.file_fingerprint FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1)
    SELECT code_path, count(DISTINCT id) AS files, count(DISTINCT file_fingerprint) AS fingerprints FROM one GROUP BY 1
""")
def agg1_files_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = live_files(views.workspace_files(spark, sf_dir))
    facts = views.file_tag_relations(spark, sf_dir).join(files, "file_fingerprint")
    return facts.groupBy("code_path").agg(F.count_distinct("id").alias("files"), F.count_distinct("file_fingerprint").alias("fingerprints"))


@query("""
    WITH ids AS (SELECT r.code_path, w.id FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1)
    SELECT code_path, count(DISTINCT id) AS files FROM ids GROUP BY 1
""")
def agg1_bitmap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by bitmaps of 32,768 ids each, which merge without the ids."""
    rows = tagged_files(spark, sf_dir)
    parts = rows.groupBy("code_path", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return parts.groupBy("code_path").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("files"))


@query("""
    WITH w AS (SELECT status, file_fingerprint FROM workspace_files)
    SELECT t.path_id, t.leaf_code, count(*) AS relations, round(max(r.confidence), 4) AS top_confidence
    FROM file_tag_relations r JOIN tag_paths t USING (code_path) JOIN w USING (file_fingerprint) WHERE w.status = 1 GROUP BY 1, 2
""")
def jn1_fact_dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = live_files(views.workspace_files(spark, sf_dir)).select("file_fingerprint")
    facts = views.file_tag_relations(spark, sf_dir).join(files, "file_fingerprint")
    sums = facts.groupBy("code_path").agg(F.count(F.lit(1)).alias("relations"), F.round(F.max("confidence"), 4).alias("top_confidence"))
    return sums.join(views.tag_paths(spark, sf_dir), "code_path").select("path_id", "leaf_code", "relations", "top_confidence")


@query("""
    WITH files AS (SELECT o_orderkey AS id, 'fp_' || o_orderkey AS file_fingerprint FROM orders)
    SELECT r.tag_code, count(DISTINCT f.id) AS files FROM file_tag_relations r JOIN files f USING (file_fingerprint) GROUP BY 1
""")
def jn2_fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a workspace table every file counts."""
    files = views.workspace_files(spark, sf_dir).select("id", "file_fingerprint")
    return views.file_tag_relations(spark, sf_dir).join(files, "file_fingerprint").groupBy("tag_code").agg(F.count_distinct("id").alias("files"))


RAW_PATHS = """
    raw AS (
        SELECT DISTINCT CASE p_partkey % 13 WHEN 0 THEN '  '
               WHEN 1 THEN '/builtin.content_tags/builtin.file_type/' || lower(p_type)
               WHEN 2 THEN '/' || lower(p_type) || '/ ' || lower(p_brand) || ' /' || lower(p_type)
               WHEN 3 THEN '/builtin.fileType/omw.06367879.n/omw.03833065.n/' || lower(p_brand)
               WHEN 4 THEN '/builtin.file_type/' || lower(p_type) || '/builtin.geographical_location/' || lower(p_brand)
               WHEN 5 THEN '/builtin.content_tags/' || lower(p_type) || '/hownet.000000043396.n/' || lower(p_brand)
               WHEN 6 THEN '/builtin.language_segmentation/' || lower(p_brand)
               WHEN 7 THEN '/builtin.content_tags/builtin.security_level/' || lower(p_brand)
               WHEN 8 THEN '/builtin.theme/' || lower(p_brand)
               WHEN 9 THEN '/builtin.processing_status'
               WHEN 10 THEN '///'
               ELSE '/builtin.content_tags//' || lower(p_type) || '/builtin.content_tags/' || lower(p_brand) END AS code_path,
               CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE lower(p_brand) END AS leaf_code FROM part)
"""


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    kind, brand, key = F.lower("p_type"), F.lower("p_brand"), F.col("p_partkey")
    written: dict[int, Column] = {
        0: F.lit("  "),
        1: F.concat(F.lit("/builtin.content_tags/builtin.file_type/"), kind),
        2: F.concat(F.lit("/"), kind, F.lit("/ "), brand, F.lit(" /"), kind),
        3: F.concat(F.lit("/builtin.fileType/omw.06367879.n/omw.03833065.n/"), brand),
        4: F.concat(F.lit("/builtin.file_type/"), kind, F.lit("/builtin.geographical_location/"), brand),
        5: F.concat(F.lit("/builtin.content_tags/"), kind, F.lit("/hownet.000000043396.n/"), brand),
        6: F.concat(F.lit("/builtin.language_segmentation/"), brand),
        7: F.concat(F.lit("/builtin.content_tags/builtin.security_level/"), brand),
        8: F.concat(F.lit("/builtin.theme/"), brand),
        9: F.lit("/builtin.processing_status"),
        10: F.lit("///"),
    }
    path = F.concat(F.lit("/builtin.content_tags//"), kind, F.lit("/builtin.content_tags/"), brand)
    for k, text in written.items():
        path = F.when(key % 13 == k, text).otherwise(path)
    return part.select(path.alias("code_path"), F.when(key % 17 == 0, " ").otherwise(brand).alias("leaf_code")).distinct()


_quoted = lambda codes: ", ".join(f"'{c}'" for c in codes)
ROOTS, PLACED = _quoted(RULES.roots), _quoted([*RULES.roots, *RULES.dimensions])


@query(f"""
    WITH {RAW_PATHS}, cut AS (
        SELECT code_path, leaf_code, list_filter(list_transform(string_split(CASE WHEN trim(code_path) = '' THEN '/builtin.content_tags/' || leaf_code ELSE code_path END, '/'), lambda x: trim(x)), lambda x: x <> '') AS s
        FROM raw WHERE trim(leaf_code) <> ''
    ), filled AS (
        SELECT code_path, leaf_code, CASE WHEN len(s) = 0 THEN ['builtin.content_tags', leaf_code] ELSE s END AS s FROM cut
    ), written AS (
        SELECT code_path, leaf_code, list_transform(s, lambda x, i: CASE WHEN i = 1 AND x = 'builtin.fileType' THEN 'builtin.file_type' WHEN x = 'omw.06367879.n' THEN 'omw.03833065.n' ELSE x END) AS s FROM filled
    ), once AS (
        SELECT code_path, leaf_code, list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM written
    ), bare AS (
        SELECT code_path, leaf_code, CASE WHEN len(s) > 1 AND s[1] = 'builtin.content_tags' AND s[2] IN ({PLACED}) THEN s[2:] ELSE s END AS s FROM once
    ), geo AS (
        SELECT code_path, leaf_code, CASE WHEN list_contains(s, 'builtin.geographical_location') THEN s[list_position(s, 'builtin.geographical_location'):] ELSE s END AS s FROM bare
    ), author AS (
        SELECT code_path, leaf_code, CASE WHEN list_contains(s, 'hownet.000000043396.n') THEN s[list_position(s, 'hownet.000000043396.n'):] ELSE s END AS s FROM geo
    ), deep AS (
        SELECT code_path, leaf_code, CASE WHEN s[1] = 'builtin.language_segmentation' THEN list_concat(['builtin.file_type', 'builtin.document'], s)
               WHEN s[1] IN ('builtin.security_level', 'builtin.processing_status') THEN list_concat(['builtin.file_purpose', 'builtin.work_document'], s) ELSE s END AS s FROM author
    ), rooted AS (
        SELECT code_path, leaf_code, CASE WHEN s[1] IN ({ROOTS}) THEN s WHEN s[1] IN ({PLACED}) THEN list_concat(['builtin.file_type'], s) ELSE list_concat(['builtin.content_tags'], s) END AS s FROM deep
    )
    SELECT code_path, leaf_code, '/' || array_to_string(s, '/') AS healed, len(s) AS depth FROM rooted
""")
def tre_healed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths split and trimmed, blanks filled, old codes rewritten, loops removed, heads put where they belong."""
    rows = healed(raw_paths(spark, sf_dir), RULES)
    return rows.select("code_path", "leaf_code", F.concat(F.lit("/"), F.array_join("codes", "/")).alias("healed"), F.size("codes").cast("long").alias("depth"))


ORDERS = """
    o AS (SELECT code, pack, CASE WHEN code <> 'builtin.content_tags' AND pack > 0 THEN pack WHEN code = 'builtin.content_tags' THEN 9999 WHEN code = 'builtin.file_type' THEN 1 WHEN code = 'builtin.file_purpose' THEN 2
                 WHEN code = 'builtin.file_source' THEN 3 WHEN code = 'hownet.000000043396.n' THEN 4 ELSE 0 END AS sort_order
          FROM (SELECT CASE WHEN p_partkey BETWEEN 1 AND 6 THEN (['builtin.file_type', 'builtin.file_purpose', 'builtin.file_source', 'hownet.000000043396.n', 'builtin.geographical_location', 'builtin.content_tags'])[p_partkey] ELSE 'builtin.p' || p_partkey END AS code,
                       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size - 20 END AS pack FROM part))
"""


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    code = F.coalesce(F.get(F.array(*map(F.lit, RULES.roots)), (F.col("p_partkey") - 1).cast("int")), F.concat(F.lit("builtin.p"), "p_partkey"))
    rows = part.select(code.alias("code"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") - 20).alias("pack"))
    return rows.withColumn("sort_order", sort_order(F.col("code"), F.col("pack"), RULES))


@query(f"WITH {ORDERS} SELECT * FROM o")
def tre11_sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_orders(spark, sf_dir)


@query(f"""
    WITH {ORDERS}
    SELECT code, position FROM (SELECT code, row_number() OVER (ORDER BY CASE WHEN sort_order > 0 THEN sort_order ELSE 9223372036854775807 END,
        coalesce(list_position([{ROOTS}], code), 7), code) AS position FROM o) WHERE position <= 50
""")
def srt2_root_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty of a forest's roots: by order, then as roots are usually shown, then by code."""
    keys = root_rank(F.col("code"), F.col("sort_order"), RULES)
    first = packed_orders(spark, sf_dir).orderBy(*keys).limit(50)
    return first.select("code", F.row_number().over(Window.orderBy(*keys)).alias("position"))


@query("SELECT * FROM (" + ROLLUP.format(scope="") + ") WHERE starts_with(code_path || '/', '/builtin.content_tags/') AND total_files > 0")
def tre16_root_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root's tree, asked for by code or by path; a root without files does not show."""
    asked = "builtin.content_tags"
    root = f"/{asked.lstrip('/')}"
    facts = tagged_files(spark, sf_dir).where(under_directory(F.col("code_path"), root))
    return rollup(facts).where("total_files > 0")


@query("""
    WITH p AS (SELECT DISTINCT r.code_path FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1 AND w.id % 3 = 0 AND w.workspace_id = 2),
    s AS (SELECT code_path, string_split(substr(code_path, 2), '/') AS s FROM p),
    n AS (SELECT code_path, i, '/' || array_to_string(s[1:i], '/') AS node, CASE WHEN i > 1 THEN '/' || array_to_string(s[1:i-1], '/') END AS parent, i = len(s) AS leaf FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)),
    u AS (SELECT node, parent, bool_or(leaf) AS direct FROM n GROUP BY 1, 2),
    gone AS (SELECT parent AS node FROM u GROUP BY 1 HAVING count(*) = 1 AND parent LIKE '/builtin.content_tags/%' INTERSECT SELECT node FROM u WHERE NOT direct),
    left_over AS (SELECT s.code_path, i, s[i] AS code FROM n JOIN s USING (code_path) WHERE node NOT IN (SELECT node FROM gone))
    SELECT code_path, '/' || string_agg(code, '/' ORDER BY i) AS shown FROM left_over GROUP BY 1
""")
def tre14_hoisted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with one child and no files of their own vanish, their child takes their place."""
    files = live_files(views.workspace_files(spark, sf_dir), workspace=2).where("id % 3 = 0")
    paths = views.file_tag_relations(spark, sf_dir).join(files, "file_fingerprint").select("code_path")
    return hoisted(paths, RULES).select("code_path", F.concat(F.lit("/"), F.array_join("codes", "/")).alias("shown"))


SHOWN = """CASE WHEN code = 'builtin.content_tags' THEN 'Content' WHEN regexp_matches(code, '_[0-9]*$') THEN 'k' || right(code, 1) ELSE ' k' || length(code) % 5 || ' ' END"""


@query(f"""
    WITH f AS (SELECT w.id, r.code_path, string_split(substr(r.code_path, 2), '/') AS s FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1),
    named AS (SELECT id, s, list_transform(s, lambda code: trim({SHOWN})) AS n FROM f),
    each AS (SELECT id, s, n, unnest(range(1, len(s) + 1)) AS k FROM named),
    shown AS (SELECT id, '/' || array_to_string(list_filter(n[1:k], lambda x, i: i = 1 OR x <> n[i - 1]), '/') AS node, '/' || array_to_string(s[1:k-1], '/') AS parent FROM each WHERE k = 1 OR n[k] <> n[k - 1]),
    per AS (SELECT node, parent, count(DISTINCT id) AS c FROM shown GROUP BY 1, 2)
    SELECT node, files, summed FROM (SELECT node, count(DISTINCT id) AS files FROM shown GROUP BY 1) JOIN (SELECT node, sum(c)::BIGINT AS summed FROM per GROUP BY 1) USING (node)
""")
def agg3_named_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree by display names: equal names of parent and child fold, equal siblings merge."""
    facts = tagged_files(spark, sf_dir)
    code = F.col("code")
    name = F.when(code == ROOT, "Content").when(code.rlike("_[0-9]*$"), F.concat(F.lit("k"), F.right(code, F.lit(1)))).otherwise(F.concat(F.lit(" k"), F.length(code) % 5, F.lit(" ")))
    codes = prefixes(views.tag_paths(spark, sf_dir).select("code_path")).select("code").distinct()
    return named_rollup(facts, codes.select("code", name.alias("name")))


@query("""
    WITH p AS (SELECT code_path, string_split(substr(code_path, 2), '/') AS s FROM tag_paths),
    n AS (SELECT DISTINCT k AS depth, '/' || array_to_string(s[1:k], '/') AS node, CASE WHEN k > 1 THEN '/' || array_to_string(s[1:k-1], '/') END AS parent_path
          FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM p))
    SELECT node AS code_path, parent_path, depth FROM n
""")
def tre9_path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes(views.tag_paths(spark, sf_dir).select("code_path")).select("code_path", "parent_path", "depth").distinct()


@query("""
    WITH p AS (SELECT string_split(substr(code_path, 2), '/') AS s FROM tag_paths),
    n AS (SELECT DISTINCT k AS depth, '/' || array_to_string(s[1:k], '/') AS node FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM p))
    SELECT depth, count(*) AS nodes FROM n GROUP BY 1
""")
def agg6_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes(views.tag_paths(spark, sf_dir).select("code_path")).select("code_path", "depth").distinct().groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""
    WITH n AS (SELECT DISTINCT (['builtin.', 'omw.', 'hownet.', '_ext.', 'mine.', ''])[1 + p_partkey % 6] || lower(p_type) || (['', '.v', '.n', '.a', '.s', '.r'])[1 + p_size % 6] AS code FROM part)
    SELECT code, CASE WHEN code LIKE 'builtin.%' THEN 'builtin' WHEN code LIKE 'omw.%' THEN 'omw' WHEN code LIKE 'hownet.%' THEN 'hownet' WHEN code LIKE '\\_ext.%' ESCAPE '\\' THEN '_ext' ELSE 'user' END AS source,
           CASE WHEN code LIKE 'omw.%.v' THEN 'v' WHEN code LIKE 'omw.%.n' OR code LIKE 'hownet.%.n' THEN 'n' WHEN code LIKE 'omw.%.a' OR code LIKE 'omw.%.s' THEN 'a' WHEN code LIKE 'omw.%.r' THEN 'r' END AS pos
    FROM n
""")
def tre10_source_and_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a code comes from, by its prefix, and its part of speech, by its suffix where its source has one."""
    part = views.table(spark, sf_dir, "part")
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    code = F.concat(at(["builtin.", "omw.", "hownet.", "_ext.", "mine.", ""], F.col("p_partkey") % 6), F.lower("p_type"), at(["", ".v", ".n", ".a", ".s", ".r"], F.col("p_size") % 6))
    codes = part.select(code.alias("code")).distinct()
    return codes.select("code", node_source(F.col("code")).alias("source"), part_of_speech(F.col("code")).alias("pos"))


NAMES = """
    WITH best AS (
        SELECT tag_code, locale, lemma FROM (
            SELECT *, row_number() OVER (PARTITION BY tag_code, locale ORDER BY is_canonical DESC, n DESC, lemma) AS k FROM tag_aliases)
        WHERE k = 1
    ), private_names AS (SELECT code, CASE WHEN length(code) % 2 = 0 THEN ' ' ELSE 'Mine ' || code END AS name FROM (SELECT DISTINCT leaf_code AS code FROM tag_paths UNION SELECT 'mine.x') WHERE right(code, 1) IN ('1', '2', 'x'))
    SELECT t.leaf_code AS code, coalesce(nullif(trim(f.lemma), ''), nullif(trim(CASE WHEN right(t.leaf_code, 1) <> '2' THEN e.lemma END), ''), nullif(trim(p.name), ''), t.leaf_code) AS name
    FROM (SELECT DISTINCT leaf_code FROM tag_paths UNION SELECT 'builtin.content_tags' UNION SELECT 'mine.x') t
    LEFT JOIN best f ON f.tag_code = t.leaf_code AND f.locale = 'fr' AND right(t.leaf_code, 1) NOT IN ('1', '2')
    LEFT JOIN best e ON e.tag_code = t.leaf_code AND e.locale = 'en'
    LEFT JOIN private_names p ON p.code = t.leaf_code
"""


@query(NAMES)
def jn3_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the asked-for language, then English, then those that the user gave, then the code; blank names are none.
    (Codes that end in 1 or 2 lack the first, those that end in 2 the second.)"""
    leaves = views.tag_paths(spark, sf_dir).select(F.col("leaf_code").alias("code"))
    codes = leaves.union(spark.createDataFrame([(ROOT,), ("mine.x",)], "code string")).distinct()
    rank = F.struct((~F.col("is_canonical")).alias("c"), (-F.col("n")).alias("n"), "lemma")
    best = views.tag_aliases(spark, sf_dir).groupBy("tag_code").agg(*[F.min_by("lemma", F.when(F.col("locale") == x, rank)).alias(x) for x in ("fr", "en")])
    last = F.right("code", F.lit(1))
    own = codes.where(last.isin("1", "2", "x")).select("code", F.when(F.char_length("code") % 2 == 0, " ").otherwise(F.concat(F.lit("Mine "), "code")).alias("own"))
    joined = codes.join(best, codes.code == best.tag_code, "left").join(own, "code", "left")
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return joined.select("code", F.coalesce(said(F.when(~last.isin("1", "2"), F.col("fr"))), said(F.when(last != "2", F.col("en"))), said(F.col("own")), "code").alias("name"))


@query("""
    WITH n AS (SELECT code_path, leaf_code, path_id, CASE WHEN path_id % 4 = 0 THEN 0 ELSE path_id % 10 END AS sort_order FROM tag_paths)
    SELECT leaf_code, code_path, row_number() OVER (ORDER BY CASE WHEN sort_order > 0 THEN sort_order ELSE 2147483647 END, code_path) AS position FROM n
""")
def srt1_node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive sort orders ascending, others last, then the code path."""
    nodes = views.tag_paths(spark, sf_dir).withColumn("sort_order", F.when(F.col("path_id") % 4 == 0, 0).otherwise(F.col("path_id") % 10))
    last = F.when(F.col("sort_order") > 0, F.col("sort_order")).otherwise(2147483647)
    return nodes.select("leaf_code", "code_path", F.row_number().over(Window.orderBy(last, "code_path")).alias("position"))


@query("SELECT p.name AS parent_name, c.code, c.name FROM tag_nodes c JOIN tag_nodes p ON c.parent = p.code WHERE p.parent IS NULL")
def jn13_child_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.tag_nodes(spark, sf_dir)
    parents = nodes.where("parent IS NULL").select(F.col("code").alias("parent"), F.col("name").alias("parent_name"))
    return nodes.join(parents, "parent").select("parent_name", "code", "name")


PACK = """
    given AS (SELECT code, max(name) AS name, list_concat(CASE WHEN length(code) % 2 = 0 THEN ['gone', code] ELSE [code] END, list(parent ORDER BY parent) FILTER (parent IS NOT NULL)) AS parents, bool_or(parent IS NOT NULL) AS below FROM tag_nodes GROUP BY code),
    known AS (SELECT g.code, g.name, list_filter(CASE WHEN below THEN parents ELSE [] END, lambda p: p <> g.code AND list_contains(cs, p))[1] AS parent, below FROM given g, (SELECT list(DISTINCT code) AS cs FROM tag_nodes))
"""


@query(f"""
    WITH RECURSIVE {PACK},
    own AS (SELECT code, name, CASE WHEN parent IS NULL AND below THEN 'builtin.content_tags' ELSE parent END AS parent FROM known),
    down AS (SELECT code, 1 AS depth FROM own WHERE parent IS NULL OR parent = 'builtin.content_tags' UNION ALL SELECT o.code, depth + 1 FROM down d JOIN own o ON o.parent = d.code WHERE depth < 64)
    SELECT own.code, name, parent AS parent_code, depth, (SELECT count(*) FROM own k WHERE k.parent = own.code) AS children FROM own LEFT JOIN (SELECT code, min(depth) AS depth FROM down GROUP BY 1) USING (code)
""")
def tre18_pack_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree without files: of a node's parents in order the first that is known and not the node itself, orphans under
    the content root; the depth is counted from the roots, so nodes of a cycle have none."""
    nodes = views.tag_nodes(spark, sf_dir)
    code = F.col("code")
    front = F.when(F.char_length("code") % 2 == 0, F.array(F.lit("gone"), code)).otherwise(F.array(code))
    given = nodes.groupBy("code").agg(F.max("name").alias("name"), F.array_sort(F.collect_set("parent")).alias("ps")).withColumn("parents", F.when(F.size("ps") > 0, F.concat(front, "ps")).otherwise(F.array().cast("array<string>")))
    listed = given.select("code", F.posexplode("parents").alias("i", "parent")).where("parent <> code")
    first = listed.join(given.select(F.col("code").alias("parent")), "parent", "left_semi").groupBy("code").agg(F.min_by("parent", "i").alias("parent"))
    own = given.join(first, "code", "left").select("code", "name", F.when(F.col("parent").isNull() & (F.size("ps") > 0), ROOT).otherwise(F.col("parent")).alias("parent"))
    own = written(own, "pack-tree")
    steps = ancestors(own.where(F.col("parent") != ROOT).select("code", "parent"), 64)
    roots = own.where(F.col("parent").isNull() | (F.col("parent") == ROOT)).select(F.col("code").alias("ancestor"))
    depth = steps.join(roots, "ancestor").select("code", (F.col("distance") + 1).alias("depth")).unionByName(roots.select(F.col("ancestor").alias("code"), F.lit(1).alias("depth"))).groupBy("code").agg(F.min("depth").alias("depth"))
    children = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("children"))
    return own.join(depth, "code", "left").join(children, "code", "left").select("code", "name", F.col("parent").alias("parent_code"), "depth", F.coalesce("children", F.lit(0)).alias("children"))
