"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Each rule rejects a document whose measure exceeds a cutoff. Cutoffs are not
set by hand: in every stratum, of the labelled documents that pass the base
rules, the cutoffs of a fixed grid are tested from the loosest to the
strictest. With k of n good documents above a cutoff, the hypothesis "the rule
rejects more than a of the good documents" is refused when P(Binomial(n, a) <=
k) is at most d; testing a measure ends at the first cutoff that is not
certified. As that order is fixed beforehand, one d covers all cutoffs of a
measure.

The risk ``alpha`` allowed to a stratum is split over its measures, and the
confidence ``delta`` over all strata and measures, both by votes of the bad
documents: each votes for the rule that catches it at the loosest cutoff.
Good documents have no say in the split, so the tests stay valid, and a rule
that catches nothing costs nothing. With probability 1 - delta no stratum
loses more than alpha of its good documents to all its rules together. Of the
certified cutoffs the one that catches the most bad documents is taken, and
of equals the loosest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, UPPER, materialize, text_column

SYMBOLS = "#*$%&|<>"
MEASURES = ("symbols", "dup_lines", "repeats", "capitals", "marks")
CUTOFFS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)
#: Share of good documents that the rules of a stratum may reject, and the chance of exceeding that anywhere.
ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def measures(docs: DataFrame, text_name: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    the helper counts n_lines, n_capitals and n_marks of every row.

    A text with no repeated 5-word window, told by the distinct count of window
    hashes, has no repeated word; only the others sort their windows, with the
    words beside the hash, so that a collision cannot count. Work is linear in
    the text but for that sort.
    """
    text = text_column(docs, text_name)
    label = F.coalesce(docs[stratum].cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    rows = docs.select(docs["doc_id"], label.alias("stratum"), text.alias("t"), F.xxhash64(text).alias("text_hash"))
    trimmed = F.btrim(F.col("t"), F.lit(ASCII_SPACE))
    space = F.lit(ASCII_SPACE)
    rows = rows.select(
        "doc_id",
        "stratum",
        "text_hash",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("w"),
        F.char_length(_without(F.col("t"), ASCII_SPACE)).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), UPPER))).cast("long").alias("n_capitals"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), "!?"))).cast("long").alias("n_marks"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, space) != "").alias("lines"),
    )
    rows = rows.select(
        "doc_id", "stratum", "text_hash", "w", "word_chars", "n_symbols", "n_capitals", "n_marks",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(5)])
    rows = rows.withColumn("win", F.when(F.size("h") >= 5, F.transform(F.sequence(F.lit(0), F.size("h") - 5), window)).otherwise(F.array().cast("array<long>")))
    held = F.transform("win", lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice("w", i + 1, 5), " ").alias("s"), i.alias("i")))
    rows = rows.withColumn("found", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(held)))
    same = lambda x, k: (F.get(F.col("found"), k)["h"] == x["h"]) & (F.get(F.col("found"), k)["s"] == x["s"])
    twice = F.filter("found", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("at", start, lambda acc, x: F.struct((acc["n"] + F.least(F.lit(5), x - acc["last"])).cast("long").alias("n"), x.alias("last")), lambda acc: acc["n"])
    return rows.select(
        "doc_id", "stratum", "text_hash", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_capitals", "n_marks",
    )


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "capitals": part("n_capitals", "word_chars"), "marks": part("n_marks", "word_chars")}


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms; 1 from the mean on, where
    no test can succeed, so that the work stays below n * p terms."""
    p = F.lit(p) if isinstance(p, float) else p
    first = n * F.log(1 - p)
    odds = F.log(p / (1 - p))
    start = F.struct(first.cast("double").alias("l"), F.exp(first).cast("double").alias("s"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["l"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.cast("double").alias("l"), (acc["s"] + F.exp(term)).cast("double").alias("s"))

    steps = F.when((k >= 1) & (k < n * p), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: F.least(acc["s"], F.lit(1.0))))


def thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row (stratum, cutoff_<measure> ...) from rows of ``measures`` with a column ``good``,
    for every stratum with a certified cutoff."""
    level = lambda r: F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: r > c))
    each = [F.struct(F.lit(m).alias("measure"), r.alias("value"), level(r).alias("level"), F.lit(-i).alias("order")) for i, (m, r) in enumerate(ratios().items())]
    rows = labelled.select("stratum", "good", F.array(*each).alias("ms"))
    vote = F.array_max(F.transform("ms", lambda x: F.struct(x["level"].alias("level"), x["order"].alias("order"), x["measure"].alias("measure"))))
    rows = rows.withColumn("vote", F.when(~F.col("good") & (vote["level"] > 0), vote["measure"]))
    held = rows.select("stratum", "good", "vote", F.explode("ms").alias("m")).select("stratum", "good", "vote", "m.measure", "m.value")
    count = lambda good, c: F.sum(F.when((F.col("good") == good) & (F.col("value") > c), 1).otherwise(0))
    sums = held.groupBy("stratum", "measure").agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("n"),
        F.count(F.when(F.col("vote") == F.col("measure"), 1)).alias("votes"),
        F.count("vote").alias("of_stratum"),
        *[count(g, c).alias(f"{'k' if g else 'b'}{i}") for i, c in enumerate(CUTOFFS) for g in (True, False)],
    )
    sums = materialize(sums, "quality-sums")  # strata x measures rows
    total = sums.agg(F.sum("votes")).first()[0] or 1
    cuts = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, c in enumerate(CUTOFFS)])
    tests = sums.where((F.col("votes") > 0) & (F.col("n") > 0)).select("stratum", "measure", "n", (F.lit(alpha) * F.col("votes") / F.col("of_stratum")).alias("a"), (F.lit(delta) * F.col("votes") / F.lit(total)).alias("d"), F.explode(cuts).alias("c"))
    # k grows as cutoffs get stricter, so what is certified is where a test from the loosest on has not ended yet
    certified = tests.select("stratum", "measure", "n", "a", "d", "c.*").where((F.col("bad") > 0) & (binomial_tail(F.col("k"), F.col("n"), F.col("a")) <= F.col("d")))
    best = certified.groupBy("stratum", "measure").agg(F.max_by("cutoff", F.struct("bad", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"cutoff_{m}") for m in MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, text_name: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, and rejected_by.

    ``labels`` (doc_id, quality 0 or 1) mark the holdout; several labels of one
    document count as good only if all are. A null or blank text has no words
    and fails the base rule. A stratum without enough labels to certify any
    cutoff has the base rule only. Repeated rows are judged alike; a null doc_id
    is unlabelled; a null stratum is one of its own; texts of any length are
    measured whole; other columns are not read.
    """
    marks = materialize(measures(docs, text_name, stratum), "quality-measures")
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    holdout = marks.where(~base_failed()).join(good, "doc_id")
    cutoffs = materialize(thresholds(holdout, alpha, delta), "quality-cutoffs").withColumnRenamed("stratum", "of")
    judged = marks.join(cutoffs, marks["stratum"] == cutoffs["of"], "left")
    broken = F.array_compact(F.array(*[F.when(r > F.col(f"cutoff_{m}"), F.lit(m)) for m, r in ratios().items()]))
    judged = judged.withColumns({"base_failed": base_failed(), "rejected_by": broken})
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by", "text_hash")


def quality_filter(docs: DataFrame, labels: DataFrame, text_name: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns as they are."""
    kept = quality_verdicts(docs, labels, text_name, stratum, alpha, delta).where("kept").select(F.col("doc_id").alias("__corvane_id"), F.col("text_hash").alias("__corvane_hash")).distinct()
    base = docs.withColumn("__corvane_row_hash", F.xxhash64(text_column(docs, text_name)))
    on = base["doc_id"].eqNullSafe(kept["__corvane_id"]) & (base["__corvane_row_hash"] == kept["__corvane_hash"])
    return base.join(kept.hint("shuffle_hash"), on, "left_semi").select(*docs.columns)
