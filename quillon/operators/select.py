"""The rows with the least keys, among any number of rows, by counting: no sort, no task that holds many of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the key that one count settles.
STEP = 3


def least_keys(rows: DataFrame, key: Column, width: int, k: int) -> Column:
    """A condition that holds for the k rows with the least keys: texts of ``width`` hex digits, compared as text.

    Each pass counts rows by the next digits within the one prefix that is still open, 16**STEP counts at most. Rows
    with equal keys at the boundary are all taken. ``rows`` is read once a pass, so it should be a table.
    """
    if k < 1:
        return F.lit(False)
    prefix, left = "", k
    while len(prefix) < width:
        inside = rows.where(F.substring(key, 1, len(prefix)) == prefix) if prefix else rows
        counts = sorted((r.d, r.n) for r in inside.groupBy(F.substring(key, len(prefix) + 1, STEP).alias("d")).agg(F.count("*").alias("n")).collect())
        for digits, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return F.lit(True)  # there are no more rows than k
        prefix += digits
        if left == n:  # all rows below the prefix belong to the k
            break
    return F.substring(key, 1, len(prefix)) <= prefix
