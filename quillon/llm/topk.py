"""Exact distributed selection of the greatest keys: no global sort, no task or driver that holds many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits settled in one pass; a pass brings at most 2**BITS counts to the driver.
BITS = 16


def ordered_bits(value: Column) -> Column:
    """A double as a long that sorts the same way (no NaN). Resolution: 2**-20 below 2**42 in size."""
    return F.round(F.least(F.greatest(value, F.lit(-(2.0**42))), F.lit(2.0**42)) * F.lit(2.0**20)).cast("bigint")


def _kth(rows: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th greatest value (k >= 1) of a long column, and how many rows with that value belong to the first k."""
    # the digits of the value, most significant first; adding 2**63 by flipping the sign bit makes them unsigned
    flipped = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    prefix: list[int] = []
    for level in range(64 // BITS):
        digits = [F.shiftrightunsigned(flipped, 64 - BITS * (i + 1)).bitwiseAND(F.lit(2**BITS - 1)) for i in range(level + 1)]
        inside = rows
        for d, p in zip(digits, prefix, strict=False):
            inside = inside.where(d == p)
        counts = sorted(((r.d, r.n) for r in inside.groupBy(digits[level].alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                prefix.append(d)
                break
            k -= n
    value = 0
    for p in prefix:
        value = value << BITS | p
    value ^= 1 << 63
    return (value - (1 << 64) if value >= 1 << 63 else value), k


def top_k(rows: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """The k rows with the greatest ``key`` (long), among equals those with the least ``tie`` (long).

    ``rows`` is read several times, so it should be a table or a checkpoint. Rows equal in both stay together: if the
    boundary falls among them, all are kept. k < 1 gives none; nulls in ``key`` are never chosen.
    """
    rows = rows.where(F.col(key).isNotNull())
    if k < 1:
        return rows.where("false")
    if rows.count() <= k:
        return rows
    bar, rest = _kth(rows, key, k)
    edge = rows.where(F.col(key) == bar).withColumn("_tie", -F.coalesce(F.col(tie), F.lit(2**62)))
    last, _ = _kth(edge, "_tie", rest)
    return rows.where((F.col(key) > bar) | ((F.col(key) == bar) & (-F.coalesce(F.col(tie), F.lit(2**62)) >= last)))
