"""Names and codes of tags: normal forms, part-of-speech classes, byte-safe cuts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trim_wide

# Parts of speech that name no thing, and first characters that open no proper name (fixed values).
NON_ENTITY = "u c p r d y e o w x m q f".split()
NO_NAME_OPENS = list("一二两三四五六七八九十这那我你他她它其各每某当在从对把被由因为与和及随而初应至以所已即如若便才就很最更太极越又再还也都总只单仅并向往朝替给按照据本同第")
SURNAMES = list("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段钱汤尹黎易常武乔贺赖龚文")
NO_HEADS = ["中央", "中间", "周围", "上面", "下面"]
GOVERNING_HEADS = ["治理", "管理", "建设", "研发"]
# Names of media domains (fixed values).
DOMAINS = {
    "video": ["video", "影视", "视频"], "audio": ["audio", "音频", "音乐"], "ebook": ["ebook", "e_book", "book", "电子书", "小说"], "manga": ["manga", "comic", "漫画"],
    "image": ["image", "picture", "photo", "图片", "图像"], "archive": ["archive", "zip", "压缩包"], "code": ["code", "source_code", "源代码", "代码"], "document": ["document", "doc", "文档", "text", "txt", "文本"],
}


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def lemma(c: Column) -> Column:
    """The form under which a word is looked up. Texts of ASCII are normal as they are."""
    return F.lower(trim_wide(F.when(c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(nfkc(c))))


def is_code(c: Column) -> Column:
    return F.trim(c).rlike("^(builtin|_ext|omw|hownet)\\.")


def unclassified(lang: Column) -> Column:
    return F.when(F.lower(F.trim(lang)).startswith("zh"), "未归类").otherwise("Unclassified")


def readable(code: Column) -> Column:
    """A code's own words, or null where it has none to show."""
    ext = F.split_part(F.substring(code, 6, 1 << 20), F.lit("."), F.lit(1))
    return (
        F.when(code.startswith("builtin.h_"), F.lit(None).cast("string"))
        .when(code.startswith("builtin."), F.translate(F.substring(code, 9, 1 << 20), "_", " "))
        .when(code.startswith("_ext.") & (ext != ""), F.translate(ext, "_", " "))
    )


def media_domain(c: Column) -> Column:
    out = F.lit("general")
    for name, words in DOMAINS.items():
        out = F.when(F.lower(c).isin(words), name).otherwise(out)
    return out


def non_entity(pos: Column) -> Column:
    t = F.trim(pos)
    return (t == "") | ((t != "eng") & F.left(t, F.lit(1)).isin(NON_ENTITY))


def compound_prefix(pos: Column) -> Column:
    return F.trim(pos).rlike("^[nabv]") | (F.trim(pos) == "eng")


def compound_suffix(pos: Column) -> Column:
    return F.trim(pos).rlike("^[nt]") | F.trim(pos).isin("vn", "an", "eng")


def proper_candidate(word: Column, pos: Column) -> Column:
    """Two to four Chinese characters that may be a name nobody has listed."""
    first = F.left(word, F.lit(1))
    shape = word.rlike("^[\\x{4e00}-\\x{9fff}]{2,4}$") & ~first.isin(NO_NAME_OPENS)
    return shape & F.when(pos == "x", first.isin(SURNAMES) & (F.char_length(word) <= 3)).otherwise(pos.isin("nr", "nt", "nz"))


def standalone_candidate(word: Column, pos: Column, admitted: Column, banned: list[str]) -> Column:
    """A word that may be a tag by itself; ``admitted``: the admissibility rules accept it."""
    proper = proper_candidate(word, pos)
    class_ok = pos.rlike("^[nt]") | pos.isin("vn", "eng", "i")
    return (F.char_length(word) >= 2) & admitted & ((class_ok & ~non_entity(pos)) | proper) & ~word.isin(*banned, "")


def compound_candidate(modifier: Column, mod_pos: Column, head: Column, head_pos: Column, admitted: Column, shells: list[str], banned: list[str]) -> Column:
    """Whether modifier and head make a tag together; shell nouns may be heads, not modifiers."""
    whole = F.concat(modifier, head)
    head_ok = (head_pos.rlike("^[nt]") | head_pos.isin("vn", "an", "eng") | head.isin(GOVERNING_HEADS)) & ~non_entity(head_pos) & ~head.isin(*banned, *NO_HEADS)
    modifier_ok = (mod_pos.rlike("^[nab]") | mod_pos.isin("vn", "eng")) & ~modifier.isin(*shells, *banned, "")
    return F.char_length(whole).between(2, 8) & admitted & ~whole.isin(*shells, *banned, "") & head_ok & modifier_ok


@F.pandas_udf(StringType())
def inspection_text(body: pd.Series, prompt: pd.Series) -> pd.Series:
    """Head of 8 KiB and tail of 4 KiB of the one text there is, or the heads of both; no character is cut."""
    head = lambda s, n: s.encode()[:n].decode("utf-8", "ignore")
    tail = lambda s, n: s.encode()[-n:].decode("utf-8", "ignore")

    def one(a: str | None, b: str | None) -> str:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b:
            return f"{head(a, 8192)}\n{head(b, 8192)}"
        only = a or b
        return only if len(only.encode()) <= 12_288 else f"{head(only, 8192)}\n...\n{tail(only, 4096)}"

    return pd.Series([one(a, b) for a, b in zip(body, prompt, strict=True)])
