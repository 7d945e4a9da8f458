"""Encoding, token files and packing against the tokenizers library."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("corvane.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from corvane.llm import packing, tokenfile  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def hard_texts(n=1500):
    rng = random.Random(0)
    letters = "abcdefghij   éÉñ'sTt!1\n\n\t ΣßİÅ日<|>　"
    fixed = ["", " ", "<|endoftext|> a  <|startoftext|>b", "ΣΑΣ ΟΔΟΣ Σ", "a b\x1cc\x85d", "it's we'LL I'M", "a" * 5000, "!" * 3000, "a\n\n b \n c  ", "日本語 한국어 русский", "é Éx ́", "x " * 3000]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + hard_texts()


def test_encoding_equals_the_library(texts):
    model, library = bpe.BpeModel(WORD), Tokenizer.from_file(WORD)
    for t in texts:
        ids = model.encode(t.encode())
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:80]
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memory_of_words_may_be_small(monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    model, library = bpe.BpeModel(WORD), Tokenizer.from_file(WORD)
    for t in texts[-200:]:
        assert np.frombuffer(model.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_whole_texts(path, texts):
    encoder, library = tokenfile.LibraryEncoder(path), Tokenizer.from_file(path)
    for found, t in zip(encoder.encode_all([t.encode() for t in texts], 0), texts, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert len(tokenfile.pack(ids, bits)) == -(-len(ids) * bits // 8)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), len(ids), bits) == ids).all()
    counts = [0, 4096, 1, 5000, 904]
    shard = tokenfile.Shard(tokenfile.shard_image([1, None, 3, 4, 5], counts, ids, bits))
    assert shard.doc_ids == [1, None, 3, 4, 5]
    for k in range(5):
        assert (shard.document(k) == ids[sum(counts[:k]) : sum(counts[: k + 1])]).all()
    assert (shard.ids(4095, 4097) == ids[4095:4097]).all()


def test_token_files(spark, texts, tmp_path, monkeypatch):
    rows = list(enumerate(texts[:300])) + [(900, None), (None, "null id"), (901, ""), (901, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "shard": F.lit("x")}).repartition(5)
    tokenfile.write_token_files(df, str(tmp_path / "t"), BYTE)
    library, at = Tokenizer.from_file(BYTE), 0
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    found = tokenfile.token_file_digests(spark, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    back = tokenfile.read_token_files(spark, str(tmp_path / "t")).collect()
    assert sorted((r.start, zlib.crc32(r.ids)) for r in back) == [(w[1], w[3]) for w in want]


def test_round_trip_query_and_operators(spark):
    rows = [(1, "Hello, World!"), (2, None), (None, ""), (1, "Hello, World!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(3))
    found = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip_digests(df, WORD).collect())
    assert [x[:2] for x in found] == [(0, 0), (1, 4), (1, 4), (2, 0)]
    decoded = bpe.decode_documents(bpe.encode_documents(df, WORD), WORD).where("doc_id = 1").first().decoded
    assert decoded == "hello</w> ,</w> world</w> !</w>" and brute.sha(decoded) == found[1][2]
    assert bpe.round_trip_digests(df.limit(0), WORD).count() == 0


def check_packing(rows, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence, by_doc


def test_packing(spark, texts):
    rows = list(enumerate(texts[:400])) + [(1000, None), (1001, "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "offset": F.lit(1)})
    found = packing.pack_documents(df, WORD).collect()
    by_sequence, by_doc = check_packing(found, 2048)
    library = Tokenizer.from_file(WORD)
    total = 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces] == [(k, k * 2048, len(ids[k * 2048 : k * 2048 + 2048]), brute.crc(ids[k * 2048 : k * 2048 + 2048])) for k in range(-(-len(ids) // 2048))]
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def test_packing_of_repeated_rows_and_split_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    rows = [(1, "a b c")] * 50 + [(k, "a b c d") for k in range(200)] + [(None, "a")]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD, capacity=10).collect()
    by_sequence, _ = check_packing(found, 10)
    assert len(found) == 251 and len({(r.sequence_id, r.offset) for r in found}) == 251
    assert len(by_sequence) <= 126


def test_plan_is_near_the_lower_bound():
    rng = random.Random(3)
    for n in (1, 10, 500, 20_000):
        counts = {}
        for _ in range(n):
            x = min(2048, max(1, int(rng.lognormvariate(6.3, 1.1))))
            counts[x] = counts.get(x, 0) + 1
        plan = packing.Plan(counts)
        got = {}
        for length, _, times, _, _ in plan.segments:
            got[length] = got.get(length, 0) + times
        assert got == counts
        large = sum(c for x, c in counts.items() if x > 1024)
        least = max(-(-sum(x * c for x, c in counts.items()) // 2048), large)
        assert plan.sequences <= least * 1.01 + 2


def test_a_word_beyond_the_vocabulary_raises():
    model = bpe.BpeModel(WORD)
    with pytest.raises(ValueError, match="does not cover"):
        model.encode_word("a☃")


@pytest.mark.parametrize("keep_space", [True, False])
def test_pieces_are_those_of_the_pattern(keep_space):
    """Every piece is its own value: joined, they are the text; looked up, they are the pattern's."""
    import regex

    from corvane.llm.pieces import encode_texts

    pattern = regex.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+" if keep_space else rb"[^ \t\n\r\x0b\x0c]+")
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab \n\t") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    number = {}

    def look_up(pieces):
        return [np.array([number.setdefault(p, len(number))], "<u4").tobytes() for p in pieces]

    found = encode_texts(texts, keep_space, look_up)
    name = {v: k for k, v in number.items()}
    for x, ids in zip(texts, found, strict=True):
        assert [name[i] for i in np.frombuffer(ids, "<u4").tolist()] == pattern.findall(x)
