"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def fit(a: Column, dim: int) -> Column:
    """The first ``dim`` components at unit length; null if there are fewer or they have no length."""
    cut = F.slice(F.transform(a, lambda x: x.cast("double")), 1, dim)
    return F.when((F.size(a) >= dim) & (norm(cut) > 1e-6), F.transform(cut, lambda x: x / norm(cut)))


def fuse(a: Column, b: Column, wa: float = 0.60, wb: float = 0.40) -> Column:
    """Weighted sum at unit length."""
    mixed = F.zip_with(a, b, lambda x, y: x.cast("double") * wa + y.cast("double") * wb)
    return F.when(norm(mixed) > 0, F.transform(mixed, lambda x: x / norm(mixed))).otherwise(mixed)


def quantise(a: Column) -> Column:
    """Components as bytes, -127 to 127."""
    return F.transform(a, lambda x: F.round(x.cast("double") * 127).cast("tinyint"))


def sign_hash(a: Column) -> Column:
    """One bit for each of up to 64 components: whether it is positive."""
    powers = F.array(*[F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long") for k in range(64)])
    bit = lambda x, i: F.when(x > 0, F.get(powers, i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(a, bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def dequantise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / 127)


def hashed_words(text: Column, dim: int = 64) -> Column:
    """Counts of words by a small hash: a vector of a text without any model, null as empty.

    The words' places, in order, fall into one run for each place, so that each
    word is read once and not once for each component. Arrays of one element hold
    what would be evaluated anew wherever a lambda names it.
    """
    place = lambda w: (F.char_length(w) * 31 + F.ascii(w)) % dim
    places = F.sort_array(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-zà-ÿ]+)")), place))
    listed = F.concat(F.array_join(places.cast("array<string>"), ","), F.lit(","))
    runs = F.regexp_extract_all(listed, F.lit("([0-9]+,)\\1*+"), F.lit(0))
    first = lambda r: F.substring_index(r, ",", 1)
    count = lambda r: F.char_length(r) / (F.char_length(first(r)) + 1)
    held = F.array(F.map_from_entries(F.transform(runs, lambda r: F.struct(first(r).cast("int"), count(r)))))
    components = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.get(F.transform(held, lambda counts: F.transform(components, lambda k: F.coalesce(F.try_element_at(counts, k), F.lit(0.0)))), F.lit(0))
