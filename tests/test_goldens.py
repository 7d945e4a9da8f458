"""Hand-made cases for scalar functions, trees, arbitration and state."""

import random
import re
import time
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import arbitration, chunks, cluster, folding, hashes, tree
from corvane.operators.graph import ancestors, components
from corvane.operators.state import crash_breaker
from corvane.plans import gates, identify, texts
from corvane.sources.files import list_files, list_tree, optional, table_or_empty
from corvane.streaming.windows import hourly, stream_table, write_hours


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_tag_verdicts(spark):
    want = {
        "": "R01", "　": "R01", "the": "R05", "人": "R07", "a1b2c3": "R04", "IMG20240101": "R04", "deadbeef": "R04", "12345": "R03", "--": "R03", "my_tag": "R04",
        "null": "R09", "one two three four five": "R02", "latинский": "R11", "lat инский": "ok", "a, bcd, efg": "R01", "(draft)": "R01", "x\ufffdy": "R10", "ab\x01c": "R10",
        "\ue000": "R10", "好吗": "R06", "such as this": "R06", "emoji 😀": "R01", "report": "ok", "日本語": "ok", "тест-test": "ok", "é": "ok", "今天天气很好我们去公园玩": "R02", "фильм": "ok",
    }
    rows = spark.createDataFrame([(k,) for k in want], "x string")
    got = {r.x: r.v for r in rows.select("x", T.tag_verdict(F.col("x"), identify.STOPWORDS, identify.RESERVED, identify.FRAMES).alias("v")).collect()}
    assert got == want


def test_codes(spark):
    assert one(spark, "  Café au_lait! ", T.slug(F.col("x"))) == "caf_au_lait"
    assert one(spark, "发票", T.builtin_code(F.col("x"))).startswith("builtin.h_")
    assert one(spark, "Tax Form", T.builtin_code(F.col("x"))) == "builtin.tax_form"
    assert one(spark, "发票", T.extension_code(F.col("x"))).count(".") == 1
    assert one(spark, "boxes", T.english_lemmas(F.col("x"))) == ["box", "boxe", "boxe"]
    assert one(spark, "cities", T.english_lemmas(F.col("x"))) == ["city", "citi", "citie", "citie"]
    assert one(spark, "a", T.english_lemmas(F.col("x"))) == []


def test_page_marks(spark):
    yes = ["Page", "## Page 3", "page 1 of 10", "PAGE: 3/9", "第 3 页", "第12页", "- 1 -", "— 7 —", "~2~"]
    no = ["", "PageRank 3", "pages of history", "page_table 4", "12", "第页", "Page 3 is the one where all of it begins", "a - 1 -"]
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", T.is_page_mark(F.col("x")).alias("y"))
    assert {r.x for r in rows.collect() if r.y} == set(yes)


def test_document_language(spark):
    want = {0: "ja", 1: "ko", 2: "ru", 3: "zh", 4: "de", 5: "fr", 6: "es", 7: "en", 8: None, 9: None, 10: "th", 11: "vi", 12: "it", 13: "nl"}
    cases = ["これはテスト", "한국어 문장", "Это русский текст", "这是中文文本", "Das ist nicht gut", "Les amis sont avec nous", "Los perros del campo", "Plain words only", "", "!", "สวัสดี", "Người Việt trong nhà", "sono anche qui", "het huis van ons"]
    got = texts.languages(spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.language for r in got} == want


def test_paths(spark):
    rules = tree.TreeRules()
    content, kind = rules.content, rules.file_type
    cases = {
        f"/{content}/{kind}/a": [kind, "a"], "/a/ b /a//c": [content, "a", "b", "c"], "  ": [content, "leaf"], f"/{content}": [content], f"/{kind}/x": [kind, "x"], f"/{content}/a/{content}": [content, "a"],
        "///": [content, "leaf"], f"/{kind}/picture/{rules.geo}/x": [rules.geo, "x"], f"/{content}/man/{rules.author}/x": [rules.author, "x"], "/builtin.fileType/x": [kind, "x"],
        "/builtin.language_segmentation/x": [kind, "builtin.document", "builtin.language_segmentation", "x"], "/builtin.security_level/x": ["builtin.file_purpose", "builtin.work_document", "builtin.security_level", "x"],
        "/builtin.theme/x": [kind, "builtin.theme", "x"], f"/{content}/builtin.theme/x": [kind, "builtin.theme", "x"], "/a/omw.06367879.n": [content, "a", "omw.03833065.n"],
    }
    rows = spark.createDataFrame([(k, "leaf") for k in cases] + [("/a/b", " ")], "code_path string, leaf_code string")
    assert {r.code_path: r.codes for r in tree.healed(rows, rules).collect()} == cases


def test_named_rollup(spark):
    """Goldens worked by hand: /r/a1 and /r/a2 are both A; A's child A folds and promotes its children."""
    facts = [(1, "/r/a1/x"), (2, "/r/a1/x"), (2, "/r/a2/x"), (3, "/r/a1/a3/y"), (3, "/r/a1/y2"), (4, "/r/a1/a3"), (4, "/r/a2")]
    names = [("r", "R"), ("a1", "A"), ("a2", " A "), ("a3", "A"), ("y", "Y"), ("y2", "Y"), ("x", " ")]
    found = tree.named_rollup(spark.createDataFrame(facts, "id int, code_path string"), spark.createDataFrame(names, "code string, name string"))
    assert {r.node: (r.files, r.summed) for r in found.collect()} == {"/R": (4, 4), "/R/A": (4, 4), "/R/A/x": (2, 3), "/R/A/Y": (1, 2)}


def test_hoisted_paths(spark):
    c = "builtin.content_tags"
    paths = [f"/{c}/a/b/c", f"/{c}/a/b/d", f"/{c}/e/f", f"/{c}/g", f"/{c}/g/h", "/other/a/b"]
    found = tree.hoisted(spark.createDataFrame([(p,) for p in paths], "code_path string"), tree.TreeRules()).collect()
    assert {r.code_path: r.codes for r in found} == {paths[0]: [c, "b", "c"], paths[1]: [c, "b", "d"], paths[2]: [c, "f"], paths[3]: [c, "g"], paths[4]: [c, "g", "h"], paths[5]: ["other", "a", "b"]}


def test_dimension_policies(spark):
    """Several subjects and themes stay, one of two screen kinds wins, weak and unmeasured tags go."""
    from corvane.operators.policies import OPPOSED_MOODS, Policies, arbitrate

    nan = float("nan")
    tags = [("person", 0.88, "builtin.subject_type"), ("pet", 0.82, "builtin.subject_type"), ("fiction", 0.85, "builtin.theme"), ("suspense", 0.79, "builtin.theme"), ("windows", 0.92, "builtin.system_ecology"),
            ("macos", 0.77, "builtin.system_ecology"), ("close", 0.45, "builtin.shot_type"), ("medium", nan, "builtin.shot_type"), ("_ext.tool", 0.75, None)]
    rows = [("f", i, c, via, [], None, x) for i, (c, x, via) in enumerate(tags)]
    schema = "file string, ordinal int, code string, via string, parents array<string>, path string, confidence double"
    kept = {r.code for r in arbitrate(spark.createDataFrame(rows, schema), Policies(), []).collect()}
    assert kept == {"person", "pet", "fiction", "suspense", "windows", "_ext.tool"}
    moods = [("g", i, c, "builtin.emotion_tags", [], None, x) for i, (c, x) in enumerate([("兴奋", 0.66), ("压抑", 0.84), ("紧张", 0.71), ("致郁", 0.75)])]
    assert {r.code for r in arbitrate(spark.createDataFrame(moods, schema), Policies(), OPPOSED_MOODS).collect()} == {"压抑", "紧张", "致郁"}


def test_rollup_counts_distinct_files(spark):
    facts = spark.createDataFrame([(1, "/r/a/b"), (1, "/r/a"), (2, "/r/a/b"), (2, "/r/a/b"), (3, "/r/c")], "id long, code_path string")
    got = {r.code_path: (r.total_files, r.direct_files) for r in tree.rollup(facts).collect()}
    assert got == {"/r": (3, 0), "/r/a": (2, 1), "/r/a/b": (2, 2), "/r/c": (1, 1)}


def test_folding(spark):
    rules = folding.FoldRules(reject=("bad",), hoist=("shell",), action=("do",))
    facts = spark.createDataFrame([(1, "/r/shell/x"), (2, "/r/x"), (3, "/r/bad/x"), (4, "/r/do/p/q"), (5, "/r/do/s/q"), (6, "/r/shell")], "id long, p string")
    got = {r.node: r.files for r in folding.folded_rollup(facts, tree.segments(F.col("p")), rules).collect()}
    assert got == {"/r": 5, "/r/x": 2, "/r/do": 2, "/r/do/p": 1, "/r/do/s": 1, "/r/do/q": 2}


def test_arbitration_of_nan_and_ties(spark):
    nan = float("nan")
    tags = spark.createDataFrame([(1, 1, "joy", "e", 0.9), (1, 2, "sad", "e", 0.9), (2, 1, "joy", "e", nan), (2, 2, "sad", "e", 0.7), (3, 1, "joy", "e", 0.5), (4, 1, "a", "s", 0.8), (4, 2, "b", "s", 0.8)], "file int, ordinal int, code string, dim string, confidence double")
    assert {(r.file, r.code) for r in arbitration.opposition_losers(tags, [("joy", "sad")]).collect()} == {(1, "sad"), (2, "joy")}
    assert {(r.file, r.code) for r in arbitration.above_threshold(tags).collect()} == {(1, "joy"), (1, "sad"), (2, "sad"), (4, "a"), (4, "b")}
    assert {r.code for r in arbitration.single_select(tags.where("file = 4"), ["s"]).collect()} == {"a"}
    scores = spark.createDataFrame([("g", "a", 0.9), ("g", "b", 0.7), ("h", "a", 0.9), ("h", "b", 0.88), ("i", "a", 0.3), ("j", "a", 0.9)], "g string, code string, c double")
    assert {(r.g, r.code) for r in arbitration.winner_by_margin(scores, ["g"], 0.5, 0.1).collect()} == {("g", "a"), ("j", "a")}


def test_vectors(spark):
    assert abs(one(spark, [3.0, 4.0], V.norm(F.col("x")), "array<double>") - 5) < 1e-12
    assert one(spark, [0.0, 0.0], V.cosine(F.col("x"), F.col("x")), "array<double>") is None
    assert one(spark, [3.0, 4.0, 9.0], V.fit(F.col("x"), 2), "array<double>") == [0.6, 0.8]
    assert one(spark, [3.0], V.fit(F.col("x"), 2), "array<double>") is None
    assert one(spark, [1.0, -1.0, 0.004], V.quantise(F.col("x")), "array<double>") == [127, -127, 1]


def test_hashes(spark):
    rng = random.Random(1)

    def slow(data):
        h = len(data) * 31 % 2**64
        for b in data[:65536] + (data[-65536:] if len(data) > 131072 else b""):
            h = (h * 31 + b) % 2**64
        return f"{h:016x}" if data else None

    cases = [b"", b"a", bytes(rng.randrange(256) for _ in range(1000)), b"x" * 65536, b"y" * 131072, bytes(rng.randrange(256) for _ in range(140_000))]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, x binary")
    got = {r.i: r.h for r in df.select("i", hashes.sampled_fingerprint("x").alias("h")).collect()}
    assert got == {i: slow(c) for i, c in enumerate(cases)}
    assert df.where("i = 1").select(hashes.fnv1a("x").alias("h")).first().h == "af63dc4c8601ec8c"


def test_chunks():
    assert chunks.chunks("") == [] and chunks.chunks("    \n\n\t   ") == []
    assert chunks.chunks("Short one, and two.") == ["Short one, and two."]
    text = "床前明月光，疑是地上霜。举头望明月，低头思故乡。" * 5
    parts = chunks.chunks(text)
    assert "".join(parts) == text and all(len(p) <= 38 for p in parts) and len(parts[0]) <= 20
    words = " ".join(f"word{i}" for i in range(200))
    found = chunks.chunks(words)
    assert " ".join(x.removesuffix(", ") for x in found) == words and max(map(len, found)) <= 40 + 4 + 2
    assert len(chunks.chunks("白日\n依山尽\n黄河\n入海流\n欲穷\n千里目\n更上\n一层楼", (40, 100, 200))) == 1
    assert "today?Everything" not in chunks.chunks("Hello world! How are you doing today? Everything is fine.", (20, 50, 80))[0]
    assert chunks.chunks("这是一段简单的测试文本，用于验证极端参数下的安全性。", (0, 0, 0))
    tight = chunks.chunks("这项技术的研发周期非常漫长，而且在早期测试中遇到过大量的内存拷贝与缓存抖动瓶颈，因此团队进行了多轮红队对抗审查。")
    assert len(tight) > 1 and not any(x.startswith(chunks.TIGHT) for x in tight)
    names = chunks.chunks("DeepSeek和Anthropic以及OpenAI都在探索下一代端侧智能体架构，并且在性能优化方面投入了巨大的研发资源。")
    assert all(n in "".join(names) for n in ("DeepSeek", "Anthropic", "OpenAI"))
    plain = "但是" + "人工智能与机器学习技术在当今数字时代已经深入到了人类社会的每一个角落" * 8
    for part in chunks.chunks(plain, (40, 100, 200)):
        assert 0 < len(part) <= 205
    emoji = "Hello world! This is a test for English segmentation. 🌟✨🚀 包含复杂表情与English混排文本，绝不能截断。"
    assert "".join("".join(chunks.chunks(emoji, (20, 50, 100))).split()) == "".join(emoji.split())


def test_clauses_keep_their_marks():
    assert chunks.clauses("a, b。c\r\nd") == [("a,", ","), ("b。", "。"), ("c", "\n"), ("d", "")]


def test_document_chunks(spark):
    text = "Intro here.\n# First\n" + "a" * 700 + "\n" + "b" * 700 + "\n## Second\n\nEnd. " + "w " * 300
    rows = spark.createDataFrame([(1, "T", text), (2, None, None)], "id int, title string, text string")
    found = {(r.id, r.chunk_no): (r.heading, r.chunk) for r in chunks.document_chunks(rows).collect()}
    assert [found[1, k][0] for k in range(1, 5)] == ["", "First", "First", "Second"] and found[2, 0] == ("", "") and len(found) == 6
    assert found[1, 2][1] == "a" * 700 and found[1, 1][1] == "Intro here." and found[1, 0][1].startswith("T\nIntro here. # First")


def test_chunk_counts_hold_the_text(spark):
    from corvane.plans.texts import txt5_chunk_counts

    rows = txt5_chunk_counts(spark, "/root/testdata/sf0.001").collect()
    texts_ = {str(r.doc_id): r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        letters = lambda x: "".join(x.split())
        assert not r.refused and r.chars >= len(letters(texts_[r.id])) and (r.chunks > 0) == bool(letters(texts_[r.id]))


def test_average_linkage():
    v = np.array([[1, 0], [0.99, 0.05], [0, 1], [0.02, 1], [-1, 0]])
    label = cluster.average_linkage(v, 0.4)
    assert label[0] == label[1] != label[2] == label[3] != label[4] != label[0]
    assert cluster.average_linkage(v[:1], 0.4).tolist() == [0]


def test_clusters_do_not_depend_on_blocks(spark):
    """Clouds far apart, every vector twice: the same clusters from one block and from blocks of eight."""
    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0][:6]
    rows = []
    for k in range(120):
        v = (centres[k % 6] + rng.normal(size=16) * 0.03).tolist()
        rows += [(f"a{k:03}", k % 2, v), (f"b{k:03}", k % 2, v)]
    rows += [("zero", 0, [0.0] * 16), ("none", 1, None)]
    df = spark.createDataFrame(rows, "fp string, label int, embedding array<double>")
    whole = {(r.fp, r.cluster) for r in cluster.clusters(df, "label").collect()}
    dealt = {(r.fp, r.cluster) for r in cluster.clusters(df, "label", block=8).collect()}
    want = {}
    for fp, label, v in rows[:-2]:
        want.setdefault((label, int(fp[1:]) % 6), []).append(fp)
    assert whole == dealt == {(fp, min(fps)) for fps in want.values() for fp in fps}
    folders = cluster.cluster_vectors(df.where("fp IN ('a000', 'b000', 'a002')"), "label").collect()
    assert {(r.fp, r.folder) for r in folders} == {("a000", "0/a000"), ("b000", "0/a000"), ("a002", "0/unclassified")}
    assert cluster.clusters(df.limit(0), "label").count() == 0


def test_searches_equal_brute_force(spark, monkeypatch):
    """Blocks of queries, ties by name, rows of another dimension left out."""
    from corvane.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(60, 8)), 1)
    vectors[10:20] = vectors[0]
    rows = [(f"v{k:02}", k % 4, k, v.tolist()) for k, v in enumerate(vectors)] + [("short", 0, 99, [1.0])]
    df = spark.createDataFrame(rows, "fp string, item int, idx int, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(7)], "query_id long, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = np.round(unit[:7] @ unit.T, 6) + 0.0
    want = {(q, r + 1, f"v{k:02}") for q in range(7) for r, k in enumerate(sorted(range(60), key=lambda k: (-score[q, k], k))[:5])}
    assert {(r.query_id, r["rank"], r.fp) for r in search.top_k(df, asked, 5).collect()} == want
    assert {(r.query_id, r.fp) for r in search.above(df, asked, 0.3).collect()} == {(q, f"v{k:02}") for q in range(7) for k in range(60) if score[q, k] >= 0.3}
    best = {(r.query_id, r.item): r.best_index for r in search.best_passages(df, asked).collect()}
    assert best == {(q, i): min(range(i, 60, 4), key=lambda k: (-score[q, k], k)) for q in range(7) for i in range(4)}
    assert search.top_k(df, asked.limit(0), 5).count() == 0


def test_near_classes(spark):
    from corvane.operators.similar import near_classes

    rng = random.Random(6)
    rows = [(k, rng.choice([0, -1, 1 << 62, 12345]) ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 3)))) for k in range(200)] + [(900, None), (901, None)]
    rows = [(k, b if b is None or b < 1 << 63 else b - (1 << 64)) for k, b in rows]
    for most in (1, 3):
        root = {k: k for k, _ in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, x in rows:
            for j, y in rows:
                if i < j and x is not None and y is not None and ((x ^ y) % (1 << 64)).bit_count() <= most:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        found = {r.id: r.class_id for r in near_classes(spark.createDataFrame(rows, "id long, bits long"), most).collect()}
        assert found == {k: find(k) for k, _ in rows}


def test_names(spark):
    from corvane.functions import naming as N

    assert one(spark, "　ＡＢＣ①ﬁ\u00a0", N.lemma(F.col("x"))) == "abc1fi"
    assert one(spark, "  Plain Word ", N.lemma(F.col("x"))) == "plain word"
    cases = {("徐冰", "x"): True, ("一个", "m"): False, ("这两种", "x"): False, ("北京", "ns"): False, ("华为", "nz"): True, ("徐冰徐冰", "x"): False, ("徐", "x"): False}
    rows = spark.createDataFrame([(w, p) for w, p in cases], "w string, p string")
    assert {(r.w, r.p): r.ok for r in rows.select("w", "p", N.proper_candidate(F.col("w"), F.col("p")).alias("ok")).collect()} == cases
    pairs = {("网络", "n", "问题", "n"): True, ("部分", "n", "人员", "n"): False, ("画面", "n", "中央", "n"): False, ("城市", "n", "治理", "v"): True, ("跑", "v", "人", "n"): False}
    rows = spark.createDataFrame(list(pairs), "m string, mp string, h string, hp string")
    ok = N.compound_candidate(F.col("m"), F.col("mp"), F.col("h"), F.col("hp"), F.lit(True), ["部分", "问题"], ["垃圾"])
    assert {(r.m, r.mp, r.h, r.hp): r.ok for r in rows.select("*", ok.alias("ok")).collect()} == pairs
    alone = N.standalone_candidate(F.col("w"), F.col("p"), F.lit(True), ["数据"])
    words = {("训练营", "n"): True, ("数据", "n"): False, ("跑步", "v"): False, ("徐冰", "x"): True, ("OCR", "eng"): True}
    rows = spark.createDataFrame(list(words), "w string, p string")
    assert {(r.w, r.p): r.ok for r in rows.select("w", "p", alone.alias("ok")).collect()} == words


def test_inspection_text(spark):
    from corvane.functions.naming import inspection_text

    long = "é" * 10_000
    rows = spark.createDataFrame([(1, long, None), (2, None, "p"), (3, " ", ""), (4, "body", "prompt"), (5, "x" * 12_288, None), (6, long, long)], "i int, a string, b string")
    found = {r.i: r.t for r in rows.select("i", inspection_text("a", "b").alias("t")).collect()}
    assert found[1] == "é" * 4096 + "\n...\n" + "é" * 2048 and found[6] == "é" * 4096 + "\n" + "é" * 4096
    assert (found[2], found[3], found[4], found[5]) == ("p", "", "body\nprompt", "x" * 12_288)


def test_diverse_keywords_weigh_every_word(spark):
    """A rare word unlike the others wins over the many frequent ones that resemble the first choice."""
    from corvane.operators.enrich import diverse_keywords

    text = " ".join([f"aaaa{'b' * (k % 3)}aaaa{'a' * k}" for k in range(80)] * 3 + ["zyxw"])
    found = diverse_keywords(spark.createDataFrame([(1, text)], "id int, text string"), k=2, diversity=0.9).first().keywords
    assert found[1] == "zyxw"


def test_crash_breaker(spark):
    rows = [(1, 1, "error"), (1, 2, "error"), (2, 1, "error"), (3, 1, "error"), (3, 2, "signup"), (4, 1, "signup"), (4, 2, "error"), (5, 1, "view")]
    got = {r.boot: (r.crashes, r.is_open) for r in crash_breaker(spark.createDataFrame(rows, "boot long, at long, kind string")).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (0, False), 4: (2, True), 5: (0, False)}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    found = list_files(spark, str(tmp_path)).collect()
    assert [(r.name, r["size"]) for r in found] == [("x.txt", 5)]
    (tmp_path / "a" / "b").mkdir()
    (tmp_path / "a" / "b" / "y.md").write_text("hi")
    tree_rows = {(r.path.split(str(tmp_path))[1], r.name, r["size"], r.is_dir) for r in list_tree(spark, str(tmp_path)).collect()}
    assert tree_rows == {("/a/x.txt", "x.txt", 5, False), ("/a/b/y.md", "y.md", 2, False), ("/a", "a", 0, True), ("/a/b", "b", 0, True)}
    assert table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert spark.range(1).select(optional(spark.range(1), "zzz", 7)).first().zzz == 7


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive in the order of their events; an event at the end closes all hours but its own."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    source = str(tmp_path / "in")
    for k in range(4):
        part = events.where((F.col("ts") >= F.lit(first + k * step)) & ((F.col("ts") < F.lit(first + (k + 1) * step)) if k < 3 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(source)
    closing = events.limit(1).withColumns({"ts": F.lit(last + timedelta(days=2)), "event_type": F.lit("closing")})
    closing.coalesce(1).write.mode("append").parquet(source)
    write_hours(stream_table(spark, source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = {(r.hour, r.event_type): (r.n, round(r.total, 6)) for r in hourly(events).collect()}
    stream = [((r.hour, r.event_type), (r.n, round(r.total, 6))) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(stream) == len(batch) and dict(stream) == batch


def test_ancestors_end_with_the_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("r", None), ("a", "c")], "code string, parent string")
    found = {(r.code, r.ancestor): r.distance for r in ancestors(edges, 64).collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 1, ("a", "a"): 2, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 2, ("x", "b"): 1, ("x", "c"): 2, ("x", "a"): 3}
    assert ancestors(edges, 1).count() == 5


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_beliefs_at_halves(spark, tmp_path):
    """Products that end in a half of the sixth place give the SQL's results, in whatever order rows arrive."""
    line = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").where(F.col("l_orderkey").isin(6096, 14211, 10600))
    for k, order in enumerate((F.col("l_linenumber"), F.desc("l_linenumber"), F.col("l_extendedprice"))):
        line.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / f"{k}" / "lineitem.parquet"))
        got = {(r.file, r.code): r.belief for r in gates.arb10_hypotheses(spark, str(tmp_path / f"{k}")).collect()}
        assert (got[6096, "builtin.A"], got[14211, "builtin.N"], got[10600, "builtin.N"]) == (0.996761, 0.979772, 0.994047)


def test_hashed_words_reads_a_word_once(spark):
    """Counts of each place, in one pass: the last assertion took 20 s when each component read the text."""
    rng = random.Random(5)
    letters = "abcxyzàéÿ"
    long = " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(200_000))
    texts_ = ["", "  ", "a", "A a1a-é\nÿ 42", "b" * 500, "same " * 3000, long]

    def brute(x):
        v = [0.0] * 64
        for w in re.findall("[a-zà-ÿ]+", x.lower()):
            v[(len(w) * 31 + ord(w[0])) % 64] += 1
        return v

    rows = spark.createDataFrame(list(enumerate([*texts_, None])), "k int, x string")
    got = {r.k: r.v for r in rows.repartition(1).select("k", V.hashed_words(F.col("x")).alias("v")).collect()}
    assert got == {k: brute(x or "") for k, x in enumerate([*texts_, None])}
    assert [sum(r.v) for r in rows.select(V.hashed_words(F.col("x"), 300).alias("v")).collect()] == [sum(brute(x or "")) for x in [*texts_, None]]
    many = spark.range(0, 200, 1, 1).select(F.concat(F.lit(long[:10_000]), "id").alias("x"))
    began = time.monotonic()
    assert many.select(V.hashed_words(F.col("x")).alias("v")).distinct().count() == 1
    assert time.monotonic() - began < 10
