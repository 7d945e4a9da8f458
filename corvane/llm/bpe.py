"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one vocabulary token that can end
its BPE encoding. An Aho-Corasick automaton (a trie with suffix links) lists
the tokens that end at each position; a candidate is the right one when it is
compatible with the last token of the prefix before it. Two tokens are
compatible when BPE, run over their concatenation, never merges across their
boundary, which is decided by undoing merges at the boundary from the latest
to the earliest. Following the stored last tokens backwards from the end of
the word yields the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import text_column
from .pieces import Memory, encode_texts, in_slices

#: Words in each of the two generations that a Python worker remembers, about 250 MB in all.
CACHE_WORDS = 600_000
#: Longest word kept in the cache, in bytes.
CACHE_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable
    Latin-1 stands for itself, every other byte for the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """A BPE vocabulary with word-end symbols, loaded from a tokenizer JSON file.

    ``encode`` takes UTF-8 bytes and returns ids as little-endian unsigned
    32-bit integers; ``decode`` takes such ids. Texts are normalised (NFC, lower
    case) and split as the file's own normaliser and pre-tokenizer say.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        end = model["end_of_word_suffix"] or ""
        if not end:
            raise ValueError("this vocabulary has no word-end symbol")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        # Symbols: a byte is one character, the last byte of a word is 256 higher.
        def symbols(token: str) -> str:
            last = token.endswith(end) and len(token) > len(end)
            body = "".join(chr(alphabet[c]) for c in (token[: -len(end)] if last else token))
            return body[:-1] + chr(ord(body[-1]) + 256) if last else body

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # the rank of the merge that makes a token
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = k
            self.parts.setdefault(c, (a, b))
            self.made.setdefault(c, k)
        self._fits: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for token, i in sorted(vocab.items(), key=lambda x: self.made.get(x[1], -1)):
            pair = self.parts.get(i)
            whole[i] = pair is None or (whole[pair[0]] and whole[pair[1]] and self._apart(*pair, formed=True))
            if whole[i]:  # a token that BPE can never emit is no candidate
                word = symbols(token)
                self._automaton.add_word(word, (len(word), i))
        self._automaton.make_automaton()
        self._memory = Memory(CACHE_WORDS, CACHE_BYTES)

    def _apart(self, a: int, b: int, formed: bool = False) -> bool:
        """Whether BPE over the two tokens' text leaves a boundary between them; formed:
        until the merge of these very two."""
        rank, parts, made = self.rank, self.parts, self.made
        until_a = until_b = 1 << 60  # when the edge token is merged on its own side
        skip = formed
        while True:
            k = rank.get((a, b))
            if k is not None and not skip and k < until_a and k <= until_b:
                return False
            skip = False
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a > at_b:
                until_a, a = at_a, parts[a][1]
            elif at_b >= 0:
                until_b, b = at_b, parts[b][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word given as symbols."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits = self._fits
        for end, (length, token) in self._automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if length < end:
                before = last[end - length]
                if before < 0:
                    continue
                key = before << 32 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    ok = fits[key] = self._apart(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        ids, at = [], n
        while at > 0:
            if not size[at]:
                raise ValueError("the vocabulary does not cover this word")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _words(self, text: str) -> list[int]:
        ids: list[int] = []
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing regards no context
        for word in self.SPLIT.findall(text.lower()):
            if not word.isascii():
                word = word.encode("utf-8").decode("latin-1")
            ids += self.encode_word(word[:-1] + chr(ord(word[-1]) + 256))
        return ids

    def _encode_chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if "<" not in text or self._split_special is None:
            return array("I", self._words(text)).tobytes()
        ids: list[int] = []
        for part in self._split_special.split(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                ids += self._words(part)
        return array("I", ids).tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Words never span ASCII white space, so that each distinct
        piece between it is encoded once and remembered."""
        cut = [x if b"<" in x else x.lower() for x in texts]
        return encode_texts(cut, False, lambda pieces: self._memory.look_up(pieces, lambda new: [self._encode_chunk(x) for x in new]))

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: tokens as they stand in the vocabulary, one space between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """The model of a file, loaded once in each Python worker."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column_name: str = "text") -> DataFrame:
    """(id, ids binary) of every row: ids as little-endian unsigned 32-bit integers.

    Null and empty texts give empty ids; repeated rows give repeated rows; other
    columns are not read; a text of any length is encoded whole.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), text_column(docs, text_column_name).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids = [x for part in in_slices(batch.column(1).cast(pa.binary()).to_pylist()) for x in bpe.encode_all(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) from rows of ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; encodes and decodes in
    one pass, so that ids and decoded texts never leave the worker.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows
    give repeated rows, a null doc_id is kept, other columns are not read. A text of
    any length is encoded whole.
    """
    rows = docs.select("doc_id", text_column(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = model(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for part in in_slices(batch.column(1).cast(pa.binary()).to_pylist()):
                for ids in bpe.encode_all(part):
                    n.append(len(ids) // 4)
                    a.append(sha(ids).hexdigest())
                    b.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
