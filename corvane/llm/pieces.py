"""Encoding of many texts at once by their distinct pieces.

The texts of a batch lie one after the other in one buffer; numpy marks where
pieces begin, Arrow numbers the distinct ones, and only these are looked up.
The ids of all pieces are then gathered in one step, so that Python's work is
one look-up for each distinct piece and not for each piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text encoded in one step.
SLICE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Memory:
    """What distinct pieces stand for, in two generations of ``size`` entries each."""

    def __init__(self, size: int, longest: int):
        self.size, self.longest = size, longest
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def look_up(self, pieces: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The value of each piece; those not remembered are made together."""
        found = list(map(self._new.get, pieces))
        if None not in found:
            return found
        at = [i for i, x in enumerate(found) if x is None]
        for i in at:
            found[i] = self._old.get(pieces[i])
        unknown = [i for i in at if found[i] is None]
        for i, value in zip(unknown, make([pieces[i] for i in unknown]), strict=True):
            found[i] = value
        for i in at:
            if len(pieces[i]) <= self.longest:
                if len(self._new) >= self.size:
                    self._old, self._new = self._new, {}
                self._new[pieces[i]] = found[i]
        return found


def in_slices(items: list[bytes], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes; a longer text ends its run."""
    part, size = [], 0
    for x in items:
        part.append(x)
        size += len(x)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _starts(data: np.ndarray, first: np.ndarray, keep_space: bool) -> np.ndarray:
    """Places where pieces begin. Texts begin at ``first`` (increasing, none empty). With
    ``keep_space`` a word has the blank in front of it, else space and words alternate."""
    space, opens = SPACE[data], np.zeros(len(data), bool)
    opens[first] = True
    start = opens.copy()
    start[1:] |= space[1:] & ~space[:-1]
    after_space = ~space[1:] & space[:-1]
    if keep_space:
        start[1:] |= after_space & (data[:-1] != 32)
        inner = space[1:-1] & space[:-2] & ~space[2:] & ~opens[2:]  # the last of a run goes to the word
        start[1:-1] |= inner
    else:
        start[1:] |= after_space
    return np.flatnonzero(start)


def encode_texts(texts: list[bytes], keep_space: bool, look_up: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
    """Ids (little-endian u4) of each text: those of its pieces, one after the other. Without
    ``keep_space`` the space between words has no ids. Texts of one call hold under 2 GB."""
    lengths = np.array([len(x) for x in texts], np.int64)
    held = np.flatnonzero(lengths)
    if not len(held):
        return [b""] * len(texts)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    first = np.cumsum(lengths)[held] - lengths[held]
    starts = _starts(data, first, keep_space)
    offsets = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    if keep_space:
        values = look_up(distinct)
    else:
        values = [b""] * len(distinct)
        words = [i for i, x in enumerate(distinct) if not SPACE[x[0]]]
        for i, ids in zip(words, look_up([distinct[i] for i in words]), strict=True):
            values[i] = ids
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.array([len(v) for v in values], np.int64) >> 2
    begin = np.cumsum(sizes) - sizes
    number = pieces.indices.to_numpy()
    size = sizes[number]
    ends = np.cumsum(size)
    ids = flat[np.repeat(begin[number] - (ends - size), size) + np.arange(int(ends[-1]))]
    bounds = np.append(0, ends)[np.append(np.searchsorted(starts, first), len(starts))]
    out, raw = [b""] * len(texts), ids.tobytes()
    for k, a, b in zip(held.tolist(), (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True):
        out[k] = raw[a:b]
    return out
