"""Path and tree operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policies import MULTI, SINGLE


def segments(path: Column) -> Column:
    """The trimmed, non-empty segments of ``/a/b/c``."""
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


@dataclass(frozen=True)
class TreeRules:
    """Codes that decide where a path belongs. Rewrites and orders are fixed values, the codes of the
    author and of work documents are parameters."""

    content: str = "builtin.content_tags"
    file_type: str = "builtin.file_type"
    purpose: str = "builtin.file_purpose"
    source: str = "builtin.file_source"
    document: str = "builtin.document"
    work_document: str = "builtin.work_document"
    geo: str = "builtin.geographical_location"
    author: str = "hownet.000000043396.n"
    language: tuple[str, ...] = ("builtin.language_segmentation",)
    filed: tuple[str, ...] = ("builtin.security_level", "builtin.processing_status")
    dimensions: tuple[str, ...] = (*SINGLE, *MULTI)
    rewrites: dict[str, str] = field(default_factory=lambda: {"omw.06367879.n": "omw.03833065.n"})
    head_rewrites: dict[str, str] = field(default_factory=lambda: {"builtin.fileType": "builtin.file_type"})

    @property
    def roots(self) -> tuple[str, ...]:
        """In the order in which they are shown."""
        return (self.file_type, self.purpose, self.source, self.author, self.geo, self.content)

    @property
    def sort_orders(self) -> dict[str, int]:
        return {self.content: 9999, self.file_type: 1, self.purpose: 2, self.source: 3, self.author: 4}


def _rewritten(code: Column, rewrites: dict[str, str]) -> Column:
    out = code
    for old, new in rewrites.items():
        out = F.when(code == old, new).otherwise(out)
    return out


def healed(rows: DataFrame, rules: TreeRules, path: str = "code_path", leaf: str = "leaf_code") -> DataFrame:
    """``rows`` plus ``codes``, the segments of the path where it belongs; rows without a leaf go.

    Blank paths hang the leaf under the content root. Old codes are rewritten and
    a repeated code keeps its first place. A content root in front of a root or
    dimension goes, and so does all that stands in front of a place or an author.
    Languages hang under documents, security levels and processing states under
    work documents, other dimensions under the file type, and any other head under
    the content root.
    """
    out = rows.where(F.trim(leaf) != "")
    filled = F.when(F.trim(path) == "", F.concat(F.lit(f"/{rules.content}/"), leaf)).otherwise(F.col(path))
    head = lambda: F.get("codes", F.lit(0))
    out = out.withColumn("codes", segments(filled))
    out = out.withColumn("codes", F.when(F.size("codes") == 0, F.array(F.lit(rules.content), F.col(leaf))).otherwise(F.col("codes")))
    step = lambda x, i: F.when(i == 0, _rewritten(_rewritten(x, rules.head_rewrites), rules.rewrites)).otherwise(_rewritten(x, rules.rewrites))
    out = out.withColumn("codes", F.array_distinct(F.transform("codes", step)))
    placed = F.coalesce(F.get("codes", F.lit(1)).isin(*rules.roots, *rules.dimensions), F.lit(False))
    out = out.withColumn("codes", F.when((head() == rules.content) & placed, F.slice("codes", F.lit(2), F.size("codes") - 1)).otherwise(F.col("codes")))
    for code in (rules.geo, rules.author):
        at = F.array_position("codes", code).cast("int")
        out = out.withColumn("codes", F.when(at > 1, F.slice("codes", at, F.size("codes") - at + 1)).otherwise(F.col("codes")))
    under = lambda *parents: F.concat(F.array(*map(F.lit, parents)), F.col("codes"))
    out = out.withColumn("codes", F.when(head().isin(*rules.language), under(rules.file_type, rules.document)).when(head().isin(*rules.filed), under(rules.purpose, rules.work_document)).otherwise(F.col("codes")))
    return out.withColumn("codes", F.when(head().isin(*rules.roots), F.col("codes")).when(head().isin(*rules.dimensions), under(rules.file_type)).otherwise(under(rules.content)))


def sort_order(code: Column, of_pack: Column, rules: TreeRules) -> Column:
    """The pack's order if it is positive, but for the content root, which stays last; else the usual one."""
    usual = F.lit(0)
    for known, order in rules.sort_orders.items():
        usual = F.when(code == known, order).otherwise(usual)
    return F.when((code != rules.content) & (F.coalesce(of_pack, F.lit(0)) > 0), of_pack).otherwise(usual)


def root_rank(code: Column, order: Column, rules: TreeRules) -> list[Column]:
    """Sort keys of roots: positive orders ascending, then the usual sequence of roots, then the code."""
    rank = F.lit(len(rules.roots))
    for i, root in enumerate(rules.roots):
        rank = F.when(code == root, i).otherwise(rank)
    return [F.when(order > 0, order).otherwise(F.lit((1 << 63) - 1)), rank, code]


def hoisted(paths: DataFrame, rules: TreeRules, path: str = "code_path") -> DataFrame:
    """(code_path, codes) of distinct paths with files, without the nodes below the content root that
    have one child and no files of their own: their children take their place."""
    nodes = prefixes(paths.select(path).distinct(), path)
    node = nodes.groupBy("code_path", "code", "depth", "parent_path").agg(F.bool_or("leaf").alias("direct"))
    children = node.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("code_path")).agg(F.count(F.lit(1)).alias("n"))
    gone = node.join(children, "code_path").where((F.col("n") == 1) & ~F.col("direct") & F.col("code_path").startswith(f"/{rules.content}/") & ~F.col("code").isin(*rules.roots)).select(F.col("code_path").alias("at"))
    steps = paths.select(path).distinct().select(path, F.posexplode(segments(F.col(path))).alias("i", "code"))
    steps = steps.withColumn("at", F.concat(F.lit("/"), F.array_join(F.slice(segments(F.col(path)), F.lit(1), F.col("i") + 1), "/")))
    left = steps.join(gone, "at", "left_anti")  # a path's steps are bounded by its depth
    return left.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]).alias("codes"))


def named_rollup(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Files of every node that a tree by display names shows, from (id, code_path) and (code, name).

    A child of its parent's name folds into it, again and again, and its children
    are promoted; siblings of one name are one node. ``files`` are the node's
    distinct files. ``summed`` is what a tree without file lists counts: distinct
    files among siblings under one parent, added up over the parents that were merged.
    Codes without a name, or with a blank one, show themselves.
    """
    steps = facts.select("code_path").distinct().select("code_path", F.posexplode(segments(F.col("code_path"))).alias("i", "code"))
    shown = F.when(F.trim("name") != "", F.trim("name")).otherwise(F.col("code"))
    steps = steps.join(names, "code", "left").select("code_path", "i", "code", shown.alias("name"))
    whole = steps.groupBy("code_path").agg(F.array_sort(F.collect_list(F.struct("i", "code", "name"))).alias("s"))
    each = whole.select("code_path", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("k"))
    other = lambda x, i: (i == 0) | (x["name"] != F.get("s", i - 1)["name"])
    each = each.where(other(F.get("s", F.col("k")), F.col("k")))
    trail = lambda upto, part: F.concat(F.lit("/"), F.array_join(F.transform(upto, lambda x: x[part]), "/"))
    nodes = each.select("code_path", trail(F.slice(F.filter("s", lambda x, i: (i <= F.col("k")) & other(x, i)), F.lit(1), F.size("s")), "name").alias("node"), trail(F.slice("s", F.lit(1), F.col("k")), "code").alias("parent"))
    pairs = facts.join(nodes, "code_path").groupBy("node", "parent", "id").agg(F.lit(1).alias("one"))
    by_parent = pairs.groupBy("node", "parent").agg(F.count("id").alias("n")).groupBy("node").agg(F.sum("n").alias("summed"))
    union = pairs.select("node", "id").distinct().groupBy("node").agg(F.count("id").alias("files"))
    return union.join(by_parent, "node")


def prefixes(rows: DataFrame, path: str = "code_path") -> DataFrame:
    """One row for every prefix of every path: code_path, code, depth, parent_path, leaf."""
    cut = rows.withColumn("__s", segments(F.col(path))).drop(path)
    each = cut.select("*", F.explode(F.sequence(F.lit(1), F.size("__s"))).alias("__k"))
    joined = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("__s", F.lit(1), n), "/"))
    return each.select(
        *[c for c in rows.columns if c != path],
        joined(F.col("__k")).alias("code_path"),
        F.get("__s", F.col("__k") - 1).alias("code"),
        F.col("__k").cast("long").alias("depth"),
        F.when(F.col("__k") > 1, joined(F.col("__k") - 1)).alias("parent_path"),
        (F.col("__k") == F.size("__s")).alias("leaf"),
    )


def rollup(facts: DataFrame) -> DataFrame:
    """Distinct files of every node from (id, code_path).

    Facts are first made distinct; each (node, file) pair then appears once in
    a partition at most, because both aggregations combine before the shuffle.
    """
    pairs = prefixes(facts).groupBy("code_path", "code", "depth", "id").agg(F.bool_or("leaf").alias("direct"))
    return pairs.groupBy("code_path", "code", "depth").agg(F.count("id").alias("total_files"), F.count(F.when(F.col("direct"), 1)).alias("direct_files"))


def under_directory(path: Column, directory: str) -> Column:
    """The directory itself or anything below it; separators are normalised, wildcards are literal."""
    base = directory.replace("\\", "/").rstrip("/")
    clean = F.translate(path, "\\", "/")
    return (clean == base) | clean.startswith(base + "/")


def valid_file(rows: DataFrame) -> DataFrame:
    """Rows with a fingerprint; ids beyond 32 unsigned bits stay but do not count."""
    return rows.where(F.trim("file_fingerprint") != "").withColumn("counted", F.col("id").between(0, 4294967295))


def node_source(code: Column) -> Column:
    out = F.when(code.startswith("builtin."), "builtin")
    for name in ("omw", "hownet", "_ext"):
        out = out.when(code.startswith(f"{name}."), name)
    return out.otherwise("user")


def part_of_speech(code: Column) -> Column:
    """Told by the code's suffix, for sources that have one."""
    omw = code.startswith("omw.")
    return (
        F.when(omw & code.endswith(".v"), "v")
        .when((omw | code.startswith("hownet.")) & code.endswith(".n"), "n")
        .when(omw & (code.endswith(".a") | code.endswith(".s")), "a")
        .when(omw & code.endswith(".r"), "r")
    )
