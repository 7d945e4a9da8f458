"""Near copies against brute-force Jaccard similarity."""

import random

import brute
import pytest

near_copies = pytest.importorskip("corvane.llm.near_copies")

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = brute.WORD.findall(brute.lower(text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            common = len(a & b)
            if a == b or common and 100 * common >= percent * (len(a) + len(b) - common):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {d: sets[find(k)][0] for k, (d, _) in enumerate(sets)}


def hard_rows():
    rng = random.Random(5)
    rows = [(10_000, None), (10_001, " \n"), (10_002, "one two"), (10_003, "ONE\ttwo")]
    base, passage = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(30)]
    for i in range(60):  # chains of near copies, some on each side of the limit
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(200)] = f"c{rng.randrange(999)}"
        rows.append((20_000 + i, " ".join(words)))
    for i in range(40):  # one passage among words of their own
        rows.append((30_000 + i, " ".join([*passage, *[f"o{i}x{k}" for k in range(rng.choice([2, 3, 5, 40, 90]))]])))
    return rows


@pytest.mark.parametrize("hot_list", [3, 128])
def test_near_copies_equal_brute_force(spark, hot_list):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + hard_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(df, hot_list=hot_list).collect()}
    assert found == components(rows)


def test_no_documents(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_drops_copies_beyond_four_bits(spark):
    """Jaccard of 0.8 or more, but more than four differing SimHash bits."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    rows = []
    for i in range(30):
        words = [f"w{i}x{k}" for k in range(120)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(10, 110), 2):
            words[at] = f"changed{i}x{at}"
        rows.append((2 * i + 1, " ".join(words)))
    assert any((brute.simhash(rows[2 * i][1]) ^ brute.simhash(rows[2 * i + 1][1])).bit_count() > 4 for i in range(30))
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(30)]


def test_verified_in_rounds(spark):
    """Every pair is verified whatever the bound of a round, and the copies of the sets asked for go."""
    from corvane.llm import _shared

    rng = random.Random(8)
    texts = [" ".join(f"v{k}x{rng.randrange(3)}" if k % 30 == 0 else f"w{k}" for k in range(60)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = _shared.materialize(near_copies.shingle_sets(docs, 1, "text"), "test-sets")
    sigs = {r.sig: shingles(texts[r.doc_id], 1) for r in sets.collect()}
    pairs = [(a, b) for a in sigs for b in sigs if a < b]
    want = {(a, b) for a, b in pairs if 100 * len(sigs[a] & sigs[b]) >= 96 * len(sigs[a] | sigs[b])}
    assert 0 < len(want) < len(pairs)
    mark = _shared.scratch_mark(spark)
    for members in (None, 1200):
        found = near_copies.verified(spark.createDataFrame(pairs, "a long, b long"), sets, 96, members)
        assert sorted(tuple(r) for r in found.select("a", "b").collect()) == sorted(want)
    assert not any("near-copies-asked" in path for path, _ in _shared._written[spark][mark:])
