"""Corpora enriched for tagging, generation checks, keyword choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Headings that say nothing about a document, and phrases that templates put before a summary (fixed values).
FRONT_MATTER = ["前言", "目录", "参考文献", "致谢", "附录", "摘要", "Abstract", "References", "Contents", "Table of Contents"]
TEMPLATE_PHRASES = ["核心要点", "中心思想", "主要内容", "摘要要点"]
TIME_LABEL = "产生时间:"


def strip_template(c: Column) -> Column:
    """A summary without its bracketed class, its time stamps and its template phrases."""
    bare = F.regexp_replace(T.trim_wide(c), "^\\[[^\\]]*\\]", "")
    timeless = F.regexp_replace(bare, f"{TIME_LABEL}[^。，\\n]*[。，\\n]", " ")
    plain = F.regexp_replace(timeless, f"({'|'.join(TEMPLATE_PHRASES)})[:：]", " ")
    return T.trim_wide(F.regexp_replace(plain, " {2,}", " "))


def outline(c: Column, budget: int = 800) -> Column:
    """Headings of a document, each once, without page marks and front matter, up to the first that
    would exceed ``budget`` characters in all."""
    lines = F.transform(F.split(c, "\n"), T.trim_wide)
    marked = F.filter(lines, lambda x: x.startswith("#") & ~T.is_page_mark(x))
    names = F.transform(marked, lambda x: T.trim_wide(F.regexp_replace(x, "^#+", "")))
    names = F.array_distinct(F.filter(names, lambda x: (x != "") & ~x.isin(FRONT_MATTER)))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("held"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.char_length(x)
        over = acc["full"] | (n > budget)
        return F.struct(F.when(over, acc["n"]).otherwise(n).alias("n"), F.when(over, acc["held"]).otherwise(F.concat(acc["held"], F.array(x))).alias("held"), over.alias("full"))

    return F.aggregate(names, start, add, lambda acc: acc["held"])


def safe_head(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut back up to 100 to white space or a Chinese stop."""
    head = F.substring(c, 1, most)
    cut = F.char_length(F.regexp_extract(head, f"(?s)^(.*[{T.WIDE_SPACE}。；])", 1)) - 1
    snapped = F.regexp_replace(F.substring(head, F.lit(1), F.greatest(cut, F.lit(0))), f"[{T.WIDE_SPACE}]+$", "")
    return F.when(F.char_length(c) <= most, c).when((cut >= max(0, most - 100)) & (snapped != ""), snapped).otherwise(head)


def enriched_corpus(rows: DataFrame, head_chars: int = 5000) -> DataFrame:
    """(id, corpus) from (id, summary, keywords, entities, body): the parts that have text, one a line."""
    words = lambda c: F.array_join(F.filter(F.transform(c, T.trim_wide), lambda x: (x != "") & (F.lower(x) != "page")), " ")
    parts = [
        T.strip_page_marks(strip_template(F.coalesce("summary", F.lit("")))),
        words(F.coalesce("keywords", F.array())),
        words(F.coalesce("entities", F.array())),
        F.array_join(outline(F.col("body")), " "),
        T.trim_wide(safe_head(T.trim_wide(T.strip_page_marks(F.col("body"))), head_chars)),
    ]
    return rows.select("id", F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n").alias("corpus"))


def is_degenerate(tokens: Column) -> Column:
    """Whether a token list ends in four equal tokens, three equal pairs or two equal quadruples."""
    n = F.size(tokens)
    tail = lambda k, back=0: F.slice(tokens, n - k - back + 1, F.lit(k))
    four = (n >= 4) & (F.size(F.array_distinct(F.when(n >= 4, tail(4)))) == 1)
    pairs = (n >= 6) & (F.when(n >= 6, tail(2)) == F.when(n >= 6, tail(2, 2))) & (F.when(n >= 6, tail(2)) == F.when(n >= 6, tail(2, 4)))
    quads = (n >= 8) & (F.when(n >= 8, tail(4)) == F.when(n >= 8, tail(4, 4)))
    return F.coalesce(four, F.lit(False)) | F.coalesce(pairs, F.lit(False)) | F.coalesce(quads, F.lit(False))


def is_complete_json(c: Column) -> Column:
    """Whether a text is one object whose braces close, braces inside strings aside."""
    clean = T.trim_wide(c)
    bare = F.regexp_replace(F.regexp_replace(clean, "(?s)\\\\.", ""), '(?s)"[^"]*"', "")
    braces = F.split(F.regexp_replace(bare, "[^{}]", ""), "")
    closes = F.aggregate(
        F.filter(braces, lambda x: x != ""),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed")),
        lambda acc, x: F.struct((acc["depth"] + F.when(x == "{", 1).otherwise(-1)).alias("depth"), (acc["closed"] | ((x == "}") & (acc["depth"] == 1))).alias("closed")),
        lambda acc: acc["closed"],
    )
    return clean.startswith("{") & clean.endswith("}") & ~bare.contains('"') & closes


def diverse_keywords(rows: DataFrame, k: int = 5, diversity: float = 0.5) -> DataFrame:
    """(id, keywords) by maximal marginal relevance from (id, text): candidates are all of a text's words
    of four letters or more, relevance is their share of it, similarity that of their letter trigrams."""

    def grams(word: str) -> set[str]:
        padded = f" {word} "
        return {padded[i : i + 3] for i in range(len(padded) - 2)}

    def one(text: str | None) -> list[str]:
        words = pd.Series((text or "").lower().split()).str.strip(".,;:!?()\"'")
        counts = words[words.str.len() > 3].value_counts()
        if counts.empty:
            return []
        names = sorted(counts.index, key=lambda w: (-counts[w], w))
        score, sets = np.array([counts[w] for w in names], float) / counts.iloc[0], [grams(w) for w in names]
        chosen: list[int] = []
        near = np.zeros(len(names))
        while len(chosen) < min(k, len(names)):
            if chosen:  # the nearest of those chosen, one more each time
                last = sets[chosen[-1]]
                near = np.maximum(near, [len(s & last) / len(s | last) for s in sets])
            gain = (1 - diversity) * score - diversity * near
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return [names[c] for c in chosen]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "keywords": part["text"].map(one)})

    return rows.select("id", "text").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, keywords array<string>")
