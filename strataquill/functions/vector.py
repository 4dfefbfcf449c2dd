"""Column expressions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either length is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once for each row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def hash_embedding(text: Column, dim: int) -> Column:
    """A unit vector from the SHA-256 bytes of a text, repeated up to `dim` values."""
    # Within a lambda Spark works out an expression anew for each element, so the digest, the raw values and their length are bound first.
    byte = lambda digest, i: F.conv(F.substr(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    raw = _bound(F.sha2(text, 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(digest, i)))
    unit = lambda r: F.transform(r["raw"], lambda x: F.when(r["length"] == 0, F.lit(0.0)).otherwise(x / r["length"]))
    return _bound(raw, lambda v: _bound(F.struct(v.alias("raw"), norm(v).alias("length")), unit))
