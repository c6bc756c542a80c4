"""Hash embeddings and vector arithmetic as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once even where use repeats it."""
    return F.transform(F.array(value), use)[0]


def _md5_bytes(text: Column) -> Column:
    byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: byte(d, i)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def repeated_hash_embedding(text: Column) -> Column:
    """The bytes of the text's md5 over 255, repeated to DIMENSION floats."""
    unit = F.transform(_md5_bytes(text), lambda b: (b / 255.0).cast("float"))
    return F.flatten(F.array_repeat(unit, DIMENSION // 16))


def unit_hash_embedding(text: Column) -> Column:
    """The bytes of the text's md5 at length one, and zeros up to DIMENSION floats."""
    sized = let(_md5_bytes(text), lambda raw: F.struct(raw.alias("raw"), norm(raw).alias("size")))
    unit = let(sized, lambda s: F.transform(s["raw"], lambda b: (b / s["size"]).cast("float")))
    return F.concat(unit, F.array_repeat(F.lit(0.0).cast("float"), DIMENSION - 16))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
