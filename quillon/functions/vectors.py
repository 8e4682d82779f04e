"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import composed


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    length = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def checked_dimension(v: Column, dimension: int) -> Column:
    """The vector; an error if it has another dimension."""
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(v).cast("string"))))


def bucket(token: Column, dimension: int) -> Column:
    """The MD5 of a token as a whole number, modulo ``dimension``: by parts of seven digits, so that nothing overflows."""
    digest = F.md5(token)
    if dimension <= 1 << 28 and dimension & (dimension - 1) == 0:  # the last digits alone decide
        return F.pmod(F.conv(F.substring(digest, 26, 7), 16, 10).cast("bigint"), F.lit(dimension)).cast("int")
    out = F.lit(0).cast("bigint")
    for at in range(1, 33, 7):
        n = min(7, 33 - at)
        out = F.pmod(out * (16**n % dimension) + F.conv(F.substring(digest, at, n), 16, 10).cast("bigint"), F.lit(dimension))
    return out.cast("int")


def embedding_tokens(text: Column) -> Column:
    """What the hash embedding counts: words of two characters or more, composed, or the text itself if it has none."""
    found = F.filter(F.split(F.lower(composed(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))
