"""Splitting text into chunks for speech."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that end a clause by strength, words that continue one, and sizes (fixed values).
STRONG, MEDIUM, WEAK = "。！？.!?\n", "；;：:", "，,、"
TIGHT = ("而且", "然后", "并且", "于是", "但是", "然而", "从而", "所以")
#: Least, wished and most characters of the first, second and later chunks.
LADDER = ((8, 14, 20), (16, 25, 35), (20, 30, 38))
SHORT, TAIL, HEAD_ROOM = 55, 15, 40
CLAUSE = re.compile(rf"([^{STRONG}{MEDIUM}{WEAK}\r]*)([{STRONG}{MEDIUM}{WEAK}\r]?)")
CHINESE = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")
WORD = re.compile(r"\s+|-|[^\W\u3040-\u30ff\u3400-\u9fff]+|.", re.S)


def clauses(text: str) -> list[tuple[str, str]]:
    """(piece, mark): pieces end with their mark; line ends stop a clause but are no part of it."""
    out = []
    for body, mark in CLAUSE.findall(text):
        mark = "\n" if mark == "\r" else mark
        if piece := (body + mark.strip()).strip():
            out.append((piece, mark))
    return out


def _glue(a: str, b: str) -> str:
    """Western pieces stay a space apart."""
    return f"{a} {b}" if a and a[-1].isascii() and not a[-1].isspace() and b[0].isascii() else a + b


def _breath(text: str, least: int, most: int) -> int:
    """Where to cut a run without marks: at the last space or hyphen from ``least`` to ``most`` characters, else
    at the end of a word, which may go on for four more, but not in front of a word that continues."""
    space = word = at = 0
    for m in WORD.finditer(text, 0, most + TAIL):
        at = m.end()
        if text[at:].lstrip().startswith(TIGHT):
            continue
        if least <= at <= most:
            word = at
            if m[0].isspace() or m[0] == "-":
                space = at
        elif m.start() < most < at <= most + 4:
            word = at
    return space or word or most


def chunks(text: str, limits: tuple[int, int, int] | None = None) -> list[str]:
    """Chunks for speech within growing limits, or within (least, wished, most) characters.

    A short text of one or two clauses stays whole. The first chunk closes at any
    mark once it has the least size; later ones at a sentence's end once they have
    the wished size, and at weaker marks too if they are not yet too long. No chunk
    closes at a comma in front of a word that continues the sentence. What has no
    mark is cut between words and given a comma; a short tail joins the chunk before
    it if that has room.
    """
    parts, ladder = clauses(text), limits is None
    if not parts:
        return []
    chinese = CHINESE.search(text) is not None
    if len(text.strip()) <= SHORT and len(parts) <= 2:
        return [parts[0][0] if len(parts) == 1 else _glue(parts[0][0], parts[1][0])]
    most = max(20, (limits or LADDER[0])[2])
    least = min(max(1, (limits or LADDER[0])[0]), most)
    stated = (least, min(max(least, (limits or LADDER[0])[1]), most), most)
    size_at = lambda k: LADDER[min(k, 2)] if ladder else stated
    out: list[str] = []

    def room() -> int:
        return HEAD_ROOM if ladder and not out else size_at(len(out))[2]

    def cut(held: str, piece: str) -> str:
        """Close what is held, unless the piece continues it, and cut the rest; what is left is held on."""
        rest = held + piece if held and piece.startswith(TIGHT) else piece
        if held and rest is piece:
            out.append(held)
        while len(rest) > room():
            low, wish, _ = size_at(len(out))
            at = _breath(rest, max(low, wish * 7 // 10), room())
            head, rest = rest[:at].strip(), rest[at:].strip()
            out.append(head if head[-1] in STRONG + MEDIUM + WEAK else head + ("，" if chinese else ", "))
        return rest

    held = ""
    for k, (piece, mark) in enumerate(parts):
        low, wish, top = size_at(len(out))
        first, size = ladder and not out, len(held) + len(piece)
        stop = 3 if mark and mark in STRONG else 2 if mark and mark in MEDIUM else 1 if mark else 0
        if stop == 1 and k + 1 < len(parts) and parts[k + 1][0].startswith(TIGHT):
            stop = 0
        if len(piece) > room():
            held = cut(held, piece)
        elif size < low:
            held = _glue(held, piece)
        elif stop and (first or (size >= wish and (stop == 3 or (size <= top and (stop == 2 or ladder))))):
            out.append(_glue(held, piece))
            held = ""
        elif size > top:
            held = cut(held, piece)
        else:
            held = _glue(held, piece)
    if held:
        if out and len(held) < TAIL and len(out[-1]) + len(held) <= size_at(len(out) - 1)[2]:
            out[-1] = _glue(out[-1], held)
        else:
            out.append(held)
    return out


def chunk_texts(rows: DataFrame) -> DataFrame:
    """(id, chunk_no, chunk, n_chunks) from (id, text); texts without words have no chunk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, k, c, len(cs)) for i, t in zip(part["id"], part["text"], strict=True) for cs in [chunks(t or "")] for k, c in enumerate(cs)]
            yield pd.DataFrame(out, columns=["id", "chunk_no", "chunk", "n_chunks"])

    return rows.mapInPandas(run, "id string, chunk_no int, chunk string, n_chunks int")


def document_chunks(rows: DataFrame, most: int = 1200, core: int = 400) -> DataFrame:
    """(id, chunk_no, title, heading, chunk) from (id, title, text): runs of whole paragraphs of at most ``most``
    characters that never cross a heading; a longer paragraph stands alone. Chunk 0 is the core: the title and
    the first ``core`` characters, cut at a word. A blank text has a core only."""

    def one(title: str, text: str) -> list[tuple[str, str]]:
        words = " ".join(text.split())
        cut = words if len(words) <= core else words[:core].rsplit(" ", 1)[0]
        out, heading, held, size = [("", f"{title}\n{cut}".strip())], "", [], 0

        def close() -> None:
            nonlocal held, size
            if held:
                out.append((heading, "\n".join(held)))
                held, size = [], 0

        for line in filter(None, map(str.strip, text.split("\n"))):
            if line.startswith("#") and line.lstrip("#").strip():
                close()
                heading = line.lstrip("#").strip()
                continue
            if held and size + len(line) + 1 > most:
                close()
            held.append(line)
            size += len(line) + 1
        close()
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, k, t or "", h, c) for i, t, x in zip(part["id"], part["title"], part["text"], strict=True) for k, (h, c) in enumerate(one(t or "", x or ""))]
            yield pd.DataFrame(out, columns=["id", "chunk_no", "title", "heading", "chunk"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("title").cast("string").alias("title"), "text").mapInPandas(run, f"id {kind}, chunk_no int, title string, heading string, chunk string")
