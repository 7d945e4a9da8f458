"""Text cleaning, language, types by extension, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunks import chunk_texts, document_chunks
from ..sources import views
from .base import query

# Types by extension (fixed values).
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "json": "application/json", "txt": "text/plain", "md": "text/plain",
}
# Types of files that can be previewed (fixed values).
PREVIEW = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "avif": "image/avif",
    "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "ogg": "video/ogg", "mov": "video/quicktime",
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/mp4", "opus": "audio/opus",
}
# Words and letters that decide the language of a Latin-script text (fixed values).
LANGUAGE_WORDS = {
    "vi": "của và người trong không được".split(),
    "de": "der die das und nicht ist ein eine für mit".split(),
    "fr": "les des dans avec pour une est que pas".split(),
    "es": "los las del para por una con que este".split(),
    "pt": "não para com uma que por dos das".split(),
    "it": "della delle degli sono anche questo con non".split(),
    "nl": "het van een voor met dat niet".split(),
}
LANGUAGE_LETTERS = {"vi": "đơư", "de": "äöüß", "fr": "éèçà", "es": "ñ¿¡", "pt": "ãõ"}


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, language): script counts over the first 1,000 characters, then words and letters.

    Scripts other than Latin decide by presence or share; for Latin script,
    German, French and Spanish need to be alone, the others follow in order, and
    English is what remains. Each step is a projection of its own, so that no
    text is cleaned twice.
    """
    skip = "\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FF0F}\\x{FF1A}-\\x{FF20}\\x{FF3B}-\\x{FF40}\\x{FF5B}-\\x{FF65}"
    rows = docs.select("doc_id", T.trim_wide(F.col("text")).alias("clean"))
    counted = F.regexp_replace(F.substring("clean", 1, 1000), f"[{T.WIDE_SPACE}!-/:-@\\[-`{{-~{skip}]", "")
    rows = rows.select("doc_id", F.lower("clean").alias("low"), counted.alias("c"))
    n = lambda characters: T.count_of(F.col("c"), characters)
    scripts = {
        "hiragana": n("\\x{3040}-\\x{309F}"),
        "katakana": n("\\x{30A0}-\\x{30FF}"),
        "hangul": n("\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}"),
        "thai": n("\\x{0E00}-\\x{0E7F}"),
        "devanagari": n("\\x{0900}-\\x{097F}"),
        "arabic": n("\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}"),
        "cyrillic": n("\\x{0400}-\\x{04FF}"),
        "han": n("\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"),
        "latin": n("A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}"),
    }
    # Of 102 parts the first may be empty and the last is the uncut rest; 100 words lie between.
    words = F.slice(F.filter(F.split("low", "[^\\p{IsAlphabetic}]+", 102), lambda w: w != ""), 1, 100)
    rows = rows.select("doc_id", "low", words.alias("w"), F.char_length("c").alias("total"), *[x.alias(s) for s, x in scripts.items()])
    has = {x: F.arrays_overlap("w", F.array(*map(F.lit, ws))) | (F.col("low").rlike(f"[{LANGUAGE_LETTERS[x]}]") if x in LANGUAGE_LETTERS else F.lit(False)) for x, ws in LANGUAGE_WORDS.items()}
    rows = rows.select("doc_id", "total", *scripts, *[x.alias(lang) for lang, x in has.items()])
    share = lambda s, least, part: (F.col(s) >= least) & (F.col(s) / F.col("total") > part)
    de, fr, es = F.col("de"), F.col("fr"), F.col("es")
    found = (
        F.when(F.col("total") < 2, F.lit(None))
        .when((F.col("hiragana") > 0) | (F.col("katakana") > 1), "ja")
        .when(F.col("hangul") > 0, "ko")
        .when(F.col("thai") > 0, "th")
        .when(F.col("devanagari") > 0, "hi")
        .when(share("arabic", 2, 0.30), "ar")
        .when(share("cyrillic", 2, 0.30), "ru")
        .when(share("han", 2, 0.15), "zh")
        .when(~share("latin", 3, 0.30), F.lit(None))
        .when(F.col("vi"), "vi")
        .when(de & ~fr & ~es, "de")
        .when(fr & ~de & ~es, "fr")
        .when(es & ~de & ~fr, "es")
        .when(F.col("pt") & ~es, "pt")
        .when(F.col("it"), "it")
        .when(F.col("nl"), "nl")
        .otherwise("en")
    )
    return rows.select("doc_id", found.alias("language"))


@query("""
    WITH d AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
    h AS (SELECT doc_id, lower(t) AS low, regexp_replace(left(t, 1000), '[\\s\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g') AS c,
                 list_filter(regexp_split_to_array(lower(t), '[^\\p{L}]+'), lambda w: w <> '')[1:100] AS w FROM d),
    f AS (SELECT doc_id, length(c) AS total, length(c) - length(regexp_replace(c, '[A-Za-zÀ-ɏ]', '', 'g')) AS latin,
                 list_has_any(w, ['của','và','người','trong','không','được']) OR regexp_matches(low, '[đơư]') AS vi,
                 list_has_any(w, ['der','die','das','und','nicht','ist','ein','eine','für','mit']) OR regexp_matches(low, '[äöüß]') AS de,
                 list_has_any(w, ['les','des','dans','avec','pour','une','est','que','pas']) OR regexp_matches(low, '[éèçà]') AS fr,
                 list_has_any(w, ['los','las','del','para','por','una','con','que','este']) OR regexp_matches(low, '[ñ¿¡]') AS es,
                 list_has_any(w, ['não','para','com','uma','que','por','dos','das']) OR regexp_matches(low, '[ãõ]') AS pt,
                 list_has_any(w, ['della','delle','degli','sono','anche','questo','con','non']) AS it,
                 list_has_any(w, ['het','van','een','voor','met','dat','niet']) AS nl FROM h)
    SELECT doc_id, CASE WHEN total < 2 OR latin < 3 OR latin / total <= 0.30 THEN NULL WHEN vi THEN 'vi' WHEN de AND NOT fr AND NOT es THEN 'de' WHEN fr AND NOT de AND NOT es THEN 'fr'
           WHEN es AND NOT de AND NOT fr THEN 'es' WHEN pt AND NOT es THEN 'pt' WHEN it THEN 'it' WHEN nl THEN 'nl' ELSE 'en' END AS language FROM f
""")
def str12_document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(views.table(spark, sf_dir, "documents"))


@query("""
    WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Page 3 of 9' || chr(10) || text WHEN doc_id % 3 = 1 THEN text || chr(10) || '- 12 -' ELSE 'PageRank ' || text END AS t, text FROM documents)
    SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 THEN t ELSE text END) AS stripped_sha256 FROM l
""")
def str24_pagination_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page marks added to the texts are found and removed, nothing else is."""
    d = views.table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Page 3 of 9\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n- 12 -"))).otherwise(F.concat(F.lit("PageRank "), "text"))
    return d.select("doc_id", F.sha2(T.strip_page_marks(marked), 256).alias("stripped_sha256"))


@query("""
    WITH p AS (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.md' WHEN 3 THEN '.pdf' WHEN 4 THEN '.xyz' ELSE '' END AS url FROM pages))
    SELECT page_id, ext, CASE ext WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'md' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
           CASE WHEN ext IN ('png', 'jpeg') THEN 'image' WHEN ext IN ('md', 'pdf') THEN 'document' ELSE 'other' END AS category FROM p
""")
def src10_mime_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.create_map(*[F.lit(x) for kv in {0: ".PNG", 1: ".jpeg", 2: ".md", 3: ".pdf", 4: ".xyz", 5: "", 6: ""}.items() for x in kv]), (F.col("page_id") % 7).cast("int"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)
    p = views.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, "\\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), F.col("ext")), F.lit("application/octet-stream"))
    kind = F.when(F.col("ext").isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image").when(F.col("ext").isin("pdf", "docx", "pptx", "xlsx", "txt", "md"), "document").when(F.col("ext") == "mp3", "audio").when(F.col("ext") == "mp4", "video").otherwise("other")
    return p.select("page_id", "ext", mime.alias("mime"), kind.alias("category"))


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'user' AND trim(text) <> '' THEN 'body' WHEN length(text) > 200 THEN 'ocr' WHEN trim(text) <> '' THEN 'asr' END AS origin, length(text) AS n FROM conversations
""")
def str22_effective_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body, else recognised print, else recognised speech."""
    c = views.table(spark, sf_dir, "conversations")
    body, ocr, asr = F.when(F.col("role") == "user", F.col("text")), F.when(F.char_length("text") > 200, F.col("text")), F.col("text")
    filled = lambda x: F.when(F.trim(x) != "", x)
    origin = F.when(filled(body).isNotNull(), "body").when(filled(ocr).isNotNull(), "ocr").when(filled(asr).isNotNull(), "asr")
    return c.select("conv_id", "turn", origin.alias("origin"), F.char_length(F.coalesce(filled(body), filled(ocr), filled(asr), F.lit(""))).cast("long").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '[0-9A-Za-zÀ-ɏ]') AS meaningful, regexp_matches(text, '\\S') AS visible FROM documents")
def str20_meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech text needs a letter or digit; visible text any character but space, control and U+FFFD."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[\\p{IsAlphabetic}\\p{IsDigit}]").alias("meaningful"), F.col("text").rlike(f"[^{T.WIDE_SPACE}\\x00-\\x1F\\x7F\\x{{FFFD}}]").alias("visible"))


@query("""
    WITH d AS (SELECT doc_id, left(text, 300) AS h, length(text) AS n FROM documents),
    c AS (SELECT doc_id, h, n, regexp_extract(h, '(?s)^(.*[\\s。；])', 1) AS cut FROM d)
    SELECT doc_id, CASE WHEN n <= 300 THEN n WHEN length(cut) >= 200 THEN length(cut) - 1 ELSE 300 END AS head_chars FROM c
""")
def str25_safe_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 characters, cut back at most 100 to a separator."""
    head, n = F.substring("text", 1, 300), F.char_length("text")
    cut = F.char_length(F.regexp_extract(head, f"(?s)^(.*[{T.WIDE_SPACE}。；])", 1))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.when(n <= 300, n).when(cut >= 200, cut - 1).otherwise(300).cast("long").alias("head_chars"))


# Literals of lower-cased text that tell source code (fixed values).
CODE_MARKS = ["public class", "public void", "private boolean", "import java", "vim命令", "normal mode", "insert mode", "split window", "function(", "console.log", "#include <", "fn main"]


@query(f"""
    WITH t AS (SELECT doc_id, CASE doc_id % 20 WHEN 1 THEN text || ' Console.LOG(x)' WHEN 2 THEN '#include  <' || text WHEN 3 THEN 'Fn MAIN' || text WHEN 4 THEN text || ' vim命令' ELSE text END AS text FROM documents)
    SELECT doc_id, coalesce({" OR ".join(f"contains(lower(text), '{x}')" for x in CODE_MARKS)}, FALSE) AS code_like FROM t
""")
def str30_code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a literal of source code or of an editor."""
    k, t = F.col("doc_id") % 20, F.col("text")
    text = F.when(k == 1, F.concat(t, F.lit(" Console.LOG(x)"))).when(k == 2, F.concat(F.lit("#include  <"), t)).when(k == 3, F.concat(F.lit("Fn MAIN"), t)).when(k == 4, F.concat(t, F.lit(" vim命令"))).otherwise(t)
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.lower(text).alias("low"))
    found = F.lit(False)
    for mark in CODE_MARKS:
        found = found | F.col("low").contains(mark)
    return rows.select("doc_id", F.coalesce(found, F.lit(False)).alias("code_like"))


@query("""
    WITH e AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS dur FROM events),
    s AS (SELECT event_id, dur, CASE WHEN dur <= 0 THEN 0 WHEN dur <= 30 THEN 1 ELSE 1 + CAST(ceil((dur - 30) / 25.0) AS BIGINT) END AS n FROM e),
    x AS (SELECT event_id, dur, unnest(range(0, n)) AS k FROM s)
    SELECT event_id, k, k * 25 AS start_s, least(k * 25 + 30, dur) AS end_s FROM x
""")
def mth6_overlapping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 30 seconds every 25; the last ends with the recording."""
    dur = F.floor(F.col("value") * 10)
    n = F.when(dur <= 0, 0).when(dur <= 30, 1).otherwise(1 + F.ceil((dur - 30) / 25)).cast("int")
    rows = views.table(spark, sf_dir, "events").select("event_id", dur.alias("dur"), n.alias("n")).where("n > 0")
    each = rows.select("event_id", "dur", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("k"))
    return each.select("event_id", "k", (F.col("k") * 25).alias("start_s"), F.least(F.col("k") * 25 + 30, F.col("dur")).alias("end_s"))


@query("SELECT n, least(140, greatest(48, n)) AS soft_tokens, CAST((90 - n % 90) / 0.20 AS BIGINT) AS max_seconds FROM (SELECT unnest(range(0, 200)) AS n)")
def mth7_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return spark.range(200).select(n.alias("n"), F.least(F.lit(140), F.greatest(F.lit(48), n)).alias("soft_tokens"), F.round((90 - n % 90) / 0.20).cast("long").alias("max_seconds"))


@query("SELECT n, CASE WHEN n = 0 THEN 0 ELSE least(100, (n * 100) // 150) END AS percent FROM (SELECT unnest(range(0, 200)) AS n)")
def mth10_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return spark.range(200).select(n.alias("n"), F.when(n == 0, 0).otherwise(F.least(F.lit(100), F.expr("(id * 100) div 150"))).alias("percent"))


@query("""
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM conversations)
    SELECT conv_id, turn, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM w
""")
def txt8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("""
    WITH dict AS (SELECT word, 'builtin.w_' || word AS code FROM words WHERE length(word) >= 4),
    hits AS (SELECT t.doc_id, d.code, count(*) AS n FROM tokens t JOIN dict d USING (word) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS rank FROM hits WHERE n >= 2)
    SELECT doc_id, code, n, rank FROM r WHERE rank <= 5
""")
def txt10_fast_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words of a document, found often enough, the five most frequent."""
    words = views.tokens(spark, sf_dir).where(F.char_length("word") >= 4)
    hits = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = hits.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.concat(F.lit("builtin.w_"), "word").alias("code")))), 1, 5).alias("t"))
    return top.select("doc_id", F.posexplode("t").alias("k", "t")).select("doc_id", "t.code", (-F.col("t.m")).alias("n"), (F.col("k") + 1).alias("rank"))


@query("""
    WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9-]+\\.[A-Za-z.]+[A-Za-z]')) AS value FROM documents)
    SELECT doc_id, 'email' AS category, value, count(*) AS n FROM l GROUP BY 1, 3
    UNION ALL SELECT doc_id, 'date', value, count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS value FROM documents) GROUP BY 1, 3
""")
def txt17_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a text by pattern."""
    patterns = {"email": "([A-Za-z0-9._]+@[A-Za-z0-9-]+\\.[A-Za-z.]+[A-Za-z])", "date": "([0-9]{4}-[0-9]{2}-[0-9]{2})"}
    named = lambda k: lambda x: F.struct(F.lit(k).alias("category"), x.alias("value"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p)), named(k)) for k, p in patterns.items()]))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("e")).groupBy("doc_id", "e.category", "e.value").agg(F.count(F.lit(1)).alias("n"))


@query()
def txt2_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech chunks of every turn."""
    turns = views.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return chunk_texts(turns)


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&amp;": "&"}
_decoded = lambda x: "".join(["replace(" * len(ENTITIES), x, *[f", '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in ENTITIES.items()]])


@query(rf"""
    WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|head|title)[^>]*>.*?</(script|style|head|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, sha256(trim(regexp_replace({_decoded("t")}, '[ 	

]+', ' ', 'g'))) AS text_sha256 FROM b
""")
def src7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of a page, menus and all: markup goes, the usual entities are decoded, the ampersand's last."""
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style|head|title)[^>]*>.*?</(script|style|head|title)>", " "), "<[^>]*>", " ")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return views.table(spark, sf_dir, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace(text, "[ \t\n\r]+", " ")), 256).alias("text_sha256"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'image/avif' WHEN page_id % 5 = 1 THEN 'video/quicktime' WHEN page_id % 5 = 2 THEN 'audio/mp4' WHEN page_id % 5 = 3 THEN 'image/jpeg' END AS preview FROM pages")
def src9_preview_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of media that can be previewed; others have none."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit("/a/File"), F.when(k == 0, ".AVIF").when(k == 1, ".mov").when(k == 2, ".m4a").when(k == 3, ".JPG").otherwise(".txt"))
    known = F.create_map(*[F.lit(x) for kv in PREVIEW.items() for x in kv])
    return views.table(spark, sf_dir, "pages").select("page_id", F.try_element_at(known, F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))).alias("preview"))


@query()
def txt5_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, characters in them and the longest one of each text; a text beyond two million characters is refused."""
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    fits = docs.where(F.char_length(F.coalesce("text", F.lit(""))) <= 2_000_000)
    each = chunk_texts(fits).groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("chunk")).alias("chars"), F.max(F.char_length("chunk")).alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("id", (F.char_length(F.coalesce("text", F.lit(""))) > 2_000_000).alias("refused")).join(each, "id", "left").select("id", "refused", zero("chunks"), zero("chars"), zero("longest"))


@query()
def txt6_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole paragraphs under a title, the core of the document first."""
    docs = views.table(spark, sf_dir, "documents")
    return document_chunks(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"))
