"""The registered queries of the operators over a whole table, against brute force."""

import base64
import hashlib

import brute
import numpy as np
import pytest

queries = pytest.importorskip("corvane.llm.queries")
from tokenizers import Tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


def test_op1(spark, documents):
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe_round_trip(spark, SF).collect()} == want


def test_op2(spark, documents):
    library, at, want = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), 0, []
    for i, t in documents:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    found = queries.op2_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == want


def test_op3(spark, documents):
    groups = {}
    for i, t in documents:
        groups.setdefault(brute.lower(t or ""), []).append(i)
    want = {i: (max(ids), len(ids), i == max(ids), brute.sha(t)) for t, ids in groups.items() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op3_exact_dedup(spark, SF).collect()} == want


def test_op4(spark, documents):
    want = {i: (n, k, brute.sha(" ".join(w))) for i, (n, k, w) in brute.substring_dedup(documents).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, SF).collect()} == want


def test_op6(spark, documents):
    library, want = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), {}
    for i, t in documents:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), brute.crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)}
    found, places = queries.op6_best_fit_packing(spark, SF).collect(), {}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_op7(spark, pages):
    import html
    import re

    want = {}
    for i, url, page in pages:
        body = page.split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        text = "\n".join(x for x in parts if x)
        want[i] = (url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op7_html_extraction(spark, SF).collect()} == want


def test_op8(spark, pages):
    first, want = {}, {}
    for i, _, page in pages:
        data = (page or "").encode()
        origin = first.setdefault(data, i)
        want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin)
    found = queries.op8_warc_round_trip(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want and len(found) == len(want)


def test_op9(spark, documents):
    want = {i: (n, k, brute.sha(t)) for i, (n, k, t) in brute.line_dedup(documents).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op9_line_dedup(spark, SF).collect()} == want


def test_op10(spark, documents):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()} == brute.components(documents)
