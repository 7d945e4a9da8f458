"""Deduplication operators against brute force, on the smallest tables and on hard cases."""

import random

import brute
import pytest
from pyspark.sql import functions as F

exact_dedup = pytest.importorskip("corvane.llm.exact_dedup")
from corvane.llm import line_dedup, simhash, substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns with names that operators use themselves
        df = df.withColumns({"fp": F.lit(1), "n_docs": F.lit("x"), "starts": F.lit(0), "length": F.lit(2), "hash": F.lit("h")})
    return df


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    longest = " ".join(f"w{i}" for i in range(30_000))
    return [*rows, (10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, longest), (10_005, longest + " tail"), (10_006, longest.upper()), (10_007, "a\nb\r\nA \n")]


def test_exact_duplicates(spark, documents):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(table(spark, documents, extra=True)).collect()}
    groups = {}
    for i, t in documents:
        groups.setdefault(brute.lower(t or ""), []).append(i)
    assert len(found) == len(documents)
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), brute.sha(t))


def test_equal_fingerprints_of_unequal_texts(spark):
    rows = [(1, "abcd"), (2, "abce"), (3, "ABCD"), (4, "abcf"), (5, "abcfg")]
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table(spark, rows), hash_of=lambda x: (0, 7)).collect()}
    assert found == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True), 5: (5, 1, True)}


@pytest.mark.parametrize("size", [7, 64])
def test_huge_texts_are_hashed_in_chunks(spark, monkeypatch, size):
    """Chunks hashed apart and added up give the fingerprint of the whole; repeated rows stay repeated."""
    rows = [(1, "A" * 200), (1, "A" * 200), (2, "a" * 200), (3, "größe " * 40), (None, "größe " * 40), (4, "short"), (5, ""), (6, None), (7, "x" * 64), (8, "X" * 65)]
    monkeypatch.setattr(exact_dedup, "HUGE_BYTES", size)
    found = exact_dedup.fingerprints(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        data = brute.lower(t or "").encode()
        a, b = exact_dedup.fingerprint(data)
        want.append((i or 0, a << 32 | b, len(data), brute.sha(brute.lower(t or ""))))
    assert sorted((r.doc_id or 0, r.fp, r.n_bytes, r.text_sha256) for r in found) == sorted(want)
    assert exact_dedup.exact_duplicates(table(spark, rows)).where("group_size = 3").count() == 3


def test_filter_holds_all_that_have_company(spark):
    rng = random.Random(9)
    rows = [(rng.getrandbits(62), rng.randrange(1 << 30)) for _ in range(2000)]
    held = exact_dedup.company_filter(spark.createDataFrame(rows, "fp long, n_bytes long"))
    import numpy as np

    at = exact_dedup._places(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    assert ((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all()


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    for cut in (0, 1, 4095, 4096, 4097, 20_000):
        left, right = data[:cut], data[cut:]
        assert exact_dedup.combine(exact_dedup.fingerprint(left), exact_dedup.fingerprint(right), len(right)) == exact_dedup.fingerprint(data)


def test_line_dedup(spark, documents):
    rows = [*documents, *[(20_000 + i, f"Common line\nown {i}\n COMMON LINE ") for i in range(12)], *[(30_000 + i, "nine times") for i in range(9)]]
    found = line_dedup.line_dedup(table(spark, rows, extra=True), min_docs=10)
    assert found.columns == ["doc_id", "text", "fp", "n_docs", "starts", "length", "hash", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in found.collect()} == brute.line_dedup(rows)


def test_line_runs_compact_and_settle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    for batch in ([(1, 1), (2, 2)], [(1, 1), (3, 3)], [(1, 1), (2, 2)], [(2, 2), (1, 1)], [(4, 4)]):
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
    assert {tuple(r) for r in runs.frequent().collect()} == {(1, 1), (2, 2)}
    assert len(runs.levels[0]) == 1 and len(runs.settled) >= 1


def test_settled_runs_are_merge_joined_without_moving(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2)
    for _ in range(2):
        runs.add(spark.createDataFrame([(k, k) for k in range(50)], "h1 long, h2 long"))
    assert runs.settled
    counts = spark.createDataFrame([(k, k) for k in range(40, 60)], "h1 long, h2 long").groupBy("h1", "h2").count()
    left = runs.unsettled(counts)
    assert {r.h1 for r in left.collect()} == set(range(50, 60))
    plan = left._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "HashJoin" not in final
    assert final.count("Exchange ") == 1  # of the batch's own aggregation


@pytest.mark.parametrize("name", ["n_lines", "n_dropped", "N_Words", "n_removed"])
def test_result_columns_replace_those_of_the_table(spark, name):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text + "\nx"), (2, text)], "doc_id long, text string").withColumn(name, F.lit("own"))
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, min_docs=2).collect()}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert lines == {1: (2, 1), 2: (1, 1)} and words == {1: (31, 0), 2: (30, 30)}


def test_substring_dedup(spark, documents):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = list(documents)
    for i in range(40):
        own = [f"o{i}x{k}" for k in range(rng.randint(0, 40))]
        a, n = rng.randint(0, 30), rng.randint(15, 30)
        rows.append((40_000 + i, " ".join([*own, *passage[a : a + n], *own[: rng.randint(0, 25)]])))
    rows += [(50_000, "a b c " * 40), (50_001, "x " * 19), (50_002, "x " * 20), (50_003, "x " * 21), (50_004, "\x0b".join(passage) + " z")]
    found = substring_dedup.substring_dedup(table(spark, rows, extra=True), respace=True)
    want = brute.substring_dedup(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in found.collect()} == {i: (n, k, " ".join(w)) for i, (n, k, w) in want.items()}


def test_simhash(spark, documents):
    rng = random.Random(3)
    rows = list(documents)
    base = [f"v{i}" for i in range(400)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(400)] = "changed"
        rows.append((60_000 + i, " ".join(words)))
    found = simhash.near_duplicates(table(spark, rows, extra=True))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == brute.components(rows)


@pytest.mark.parametrize("limit", [4, 1 << 16])
def test_simhash_long_lists_lose_no_link(spark, limit):
    """Dense clouds of fingerprints; with the small limit lists are split twice."""
    rng = random.Random(4)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from corvane.llm.components import connected_components

    edges = simhash.near_edges(df, 4, list_limit=limit)
    got = {}
    for r in connected_components(edges).collect():
        got.setdefault(r.root, set()).add(r.node)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                p, q = find(signed[i]), find(signed[j])
                root[max(p, q)] = min(p, q)
    want = {}
    for x in signed:
        want.setdefault(find(x), set()).add(x)
    assert {r: s for r, s in want.items() if len(s) > 1} == got


def test_position_pairs_meet_every_minimum():
    from itertools import combinations

    for bits in range(1, 6):
        pairs = simhash.position_pairs(bits)
        assert all(any(set(p) <= set(s) for p in pairs) for s in combinations(range(8), 8 - bits))


def test_empty_and_repeated_rows(spark):
    empty = table(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    text = " ".join(f"r{i}" for i in range(25))
    twice = table(spark, [(1, text), (1, text), (None, text), (2, text), (None, None)])
    exact = exact_dedup.exact_duplicates(twice).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact) == [(0, 0, 1, True), (0, 2, 4, False), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True)]
    assert sorted(r.n_removed for r in substring_dedup.substring_dedup(twice).collect()) == [0, 0, 25, 25, 25]
    assert line_dedup.line_dedup(twice, min_docs=4).where("n_dropped = 1").count() == 4
    near = simhash.near_duplicates(twice).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
