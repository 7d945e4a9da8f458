"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it; the built-in trim strips U+0020 only.
WIDE_SPACE = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def trim_wide(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")


def hash8(c: Column) -> Column:
    """The first eight hexadecimal digits of SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(8))


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(trim_wide(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def builtin_code(c: Column) -> Column:
    """Code of a controlled tag from its English name."""
    clean = trim_wide(c)
    bare = (slug(c) == "") | clean.rlike("[\\x{4e00}-\\x{9fff}]")
    return F.when(bare, F.concat(F.lit("builtin.h_"), hash8(clean))).otherwise(F.concat(F.lit("builtin."), slug(c)))


def extension_code(c: Column) -> Column:
    """Code of an open-set tag: its slug, if any, and its hash."""
    clean = trim_wide(c)
    return F.when(slug(c) == "", F.concat(F.lit("_ext."), hash8(clean))).otherwise(F.concat(F.lit("_ext."), slug(c), F.lit("."), hash8(clean)))


def english_lemmas(c: Column) -> Column:
    """Possible base forms of an inflected English word, likeliest first."""
    n = F.octet_length(c)
    cut = lambda k, tail="": F.concat(F.substring(c, F.lit(1), F.char_length(c) - k), F.lit(tail))
    rules = [
        (c.endswith("ies") & (n > 4), cut(3, "y")),
        (c.endswith("es") & (n > 3), cut(2)),
        (c.endswith("es") & (n > 3), cut(1)),
        (c.endswith("s") & ~c.endswith("ss") & (n > 3), cut(1)),
        (c.endswith("ied") & (n > 4), cut(3, "y")),
        (c.endswith("ed") & (n > 4), cut(2)),
        (c.endswith("ed") & (n > 4), cut(1)),
        (c.endswith("ing") & (n > 5), cut(3)),
        (c.endswith("ing") & (n > 5), cut(3, "e")),
    ]
    return F.array_compact(F.array(*[F.when(rule, form) for rule, form in rules]))


# Scripts by code point ranges, as values of a character class (fixed values).
SCRIPTS: dict[str, str] = {
    "han": "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2EE5F}\\x{2F800}-\\x{2FA1F}\\x{30000}-\\x{323AF}",
    "hiragana": "\\x{3040}-\\x{309F}",
    "katakana": "\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}",
    "hangul": "\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97C}\\x{AC00}-\\x{D7FF}",
    "cyrillic": "\\x{0400}-\\x{052F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}",
    "arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}",
    "latin": "A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{2C60}-\\x{2C7F}\\x{A720}-\\x{A7FF}\\x{AB30}-\\x{AB6F}",
}
FORBIDDEN = "\\x{00}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFD}\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}"
NEUTRAL = "0-9_·\\-"


def count_of(c: Column, characters: str) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{characters}]", ""))


def tag_language(c: Column) -> Column:
    """Language of a tag: that of its first character of a deciding script, else English."""
    first = F.regexp_extract(c, "([\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{4E00}-\\x{9FFF}])", 1)
    return (
        F.when(first == "", "en")
        .when(first.rlike("[\\x{3040}-\\x{30FF}]"), "ja")
        .when(first.rlike("[\\x{AC00}-\\x{D7AF}]"), "ko")
        .when(first.rlike("[\\x{0400}-\\x{04FF}]"), "ru")
        .when(first.rlike("[\\x{0600}-\\x{06FF}]"), "ar")
        .otherwise("zh")
    )


def is_hash_like(c: Column) -> Column:
    """Hexadecimal of mixed digits and letters, or of a usual digest's length."""
    return c.rlike("^[0-9A-Fa-f]{4,}$") & ((c.rlike("[0-9]") & c.rlike("[A-Fa-f]")) | F.char_length(c).isin(8, 16, 32, 40, 64))


# Prefixes that cameras and tools give to file names (fixed values).
SERIAL_PREFIXES = "DSC DSCN IMG VID PXL MVI SCREENSHOT PHOTO IMAGE DJI GOPR".split()


def is_serial(c: Column) -> Column:
    """Letters and digits of a numbered file name."""
    letters, digits = count_of(c, "A-Za-z"), count_of(c, "0-9")
    mixed = c.rlike("^[A-Za-z0-9]+$") & (letters > 0) & (digits > 0)
    return mixed & (((digits >= 3) & (letters <= 5) & (digits >= letters)) | F.upper(c).rlike(f"^({'|'.join(SERIAL_PREFIXES)})[0-9]+$"))


def tag_verdict(c: Column, stopwords: list[str], reserved: list[str], frames: list[str]) -> Column:
    """The first admissibility rule that a tag breaks, or ``ok``."""
    clean = trim_wide(c)
    present = {s: clean.rlike(f"[{r}]") for s, r in SCRIPTS.items()}
    every = "".join(SCRIPTS.values())
    bare = F.regexp_replace(clean, f"[{WIDE_SPACE}{NEUTRAL}]", "")
    mixed = (present["latin"] & present["cyrillic"]) | (present["latin"] & present["arabic"]) | (present["cyrillic"] & present["arabic"])
    han = count_of(clean, SCRIPTS["han"])
    cjk = count_of(clean, SCRIPTS["han"] + SCRIPTS["hiragana"] + SCRIPTS["katakana"] + SCRIPTS["hangul"])
    latin_words = F.size(F.filter(F.split(clean, f"[{WIDE_SPACE}_·\\-]"), lambda w: w != ""))
    clauses = F.filter(F.transform(F.split(clean, "[,，;；.。!！?？]"), trim_wide), lambda x: x != "")
    framed = F.lit(False)
    for f in frames:
        framed = framed | clean.contains(f)
    rules = [
        ("R01", clean == ""),
        ("R10", clean.rlike(f"[{FORBIDDEN}]")),
        ("R01", bare.rlike(f"[^{every}]")),
        ("R03", bare == ""),
        ("R11", mixed & ~clean.rlike(f"[{WIDE_SPACE}_·\\-]")),
        ("R02", (han > 10) | ((han == 0) & (latin_words > 4))),
        ("R04", is_hash_like(clean) | is_serial(clean) | clean.contains("_")),
        ("R05", F.lower(clean).isin(stopwords) if stopwords else F.lit(False)),
        ("R06", framed | ((F.size(clauses) >= 2) & F.exists(clauses, lambda x: F.char_length(x) >= 3)) | clean.rlike("[吗吧呢]$")),
        ("R07", (cjk == 1) & ~clean.rlike(f"[{SCRIPTS['latin']}{SCRIPTS['cyrillic']}{SCRIPTS['arabic']}]")),
        ("R08", clean.rlike("[()（）]")),
        ("R09", F.lower(clean).isin(reserved) if reserved else F.lit(False)),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise("ok")


def is_page_mark(line: Column) -> Column:
    """A line that only numbers a page: "page 3 of 9", "第 3 页", "- 3 -"."""
    clean = trim_wide(F.regexp_replace(trim_wide(line), "^#+", ""))
    low = F.lower(clean)
    short = (clean != "") & (F.octet_length(clean) <= 32)
    page = low.rlike("^page$") | (low.rlike(f"^page[{WIDE_SPACE}]*[-_:]*[{WIDE_SPACE}]*(([0-9/.\\-]+|of)([{WIDE_SPACE}]+|$))*$") & low.rlike("[0-9]"))
    chinese = clean.rlike("^第[0-9 /]+页$") & clean.rlike("^第[ ]*[0-9/]")
    dashed = clean.rlike("^[-—~ ]*[0-9]+[-—~ ]*$") & clean.rlike("[-—~ ]")
    return short & (page | chinese | dashed)


def strip_page_marks(c: Column) -> Column:
    lines = F.split(F.regexp_replace(c, "\\r\\n", "\n"), "\n")
    return F.array_join(F.filter(lines, lambda x: ~is_page_mark(x)), "\n")
