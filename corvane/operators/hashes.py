"""Unsigned 64-bit hashes, which Spark's signed arithmetic does not offer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 64 * 1024
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(HEAD, 31, np.uint64)])


def _polynomial(seed: int, data: bytes) -> int:
    """seed * 31**n + sum of byte * 31**(n-1-i), modulo 2**64, in one vector product."""
    n = len(data)
    total = (np.frombuffer(data, np.uint8).astype(np.uint64) * _POWERS[:n][::-1]).sum(dtype=np.uint64)
    return (seed * int(_POWERS[n]) + int(total)) % (1 << 64)


@F.pandas_udf(T.StringType())
def sampled_fingerprint(content: pd.Series) -> pd.Series:
    """16 hexadecimal digits from the length, the first 64 KiB and, beyond 128 KiB, the last 64 KiB; null for nothing."""

    def one(data: bytes | None) -> str | None:
        if not data:
            return None
        h = _polynomial(len(data) * 31 % (1 << 64), data[:HEAD])
        if len(data) > 2 * HEAD:
            h = _polynomial(h, data[-HEAD:])
        return f"{h:016x}"

    return content.map(one)


@F.pandas_udf(T.StringType())
def fnv1a(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of 64 bits as 16 hexadecimal digits."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    for part in parts:
        yield part.map(one)
