"""How well the tokens of two texts cover each other: greedy alignment by the largest cosine.

A token's vector counts its character trigrams, hashed into buckets as the hash embedding does with words, so tokens that
share stems are near each other and nothing has to be loaded. Each token of one text goes with the nearest one of the
other; the weighted means of these cosines are the recall (over the reference's tokens) and the precision (over the
answer's). Weights are inverse document frequencies over the references, or one.

Pairs are scored in blocks: distinct tokens of many pairs of like size are padded to one width, and one batched matrix
product gives all their cosines; a mask keeps the padding out of the maxima. A pair too large for a block is cut into
tiles of rows. Weights are joined by token before, so no vocabulary is broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.store import exists

DIMENSION = 1024
GRAM = 3
#: Numbers in the vectors, and in the cosines, of a block; tokens whose grams a task remembers; pairs taken apart at once.
BLOCK, KEPT, ROWS = 1 << 21, 100_000, 256


def grams(token: str) -> list[str]:
    """The trigrams of a token between its marks of beginning and end; a shorter one whole."""
    marked = f"<{token}>"
    return [marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))]


class _Buckets(dict):
    """token -> (buckets of its grams, their share of a vector of length one); a gram is hashed once for all tokens."""

    def __init__(self, dimension: int):
        self.dimension = dimension
        self.hashed: dict[str, int] = {}

    def bucket(self, gram: str) -> int:
        found = self.hashed.get(gram)
        if found is None:
            if len(self.hashed) >= KEPT:
                self.hashed.clear()
            found = self.hashed[gram] = int(hashlib.md5(gram.encode("utf-8", "replace"), usedforsecurity=False).hexdigest(), 16) % self.dimension
        return found

    def __missing__(self, token: str) -> tuple[list[int], list[float]]:
        if len(self) >= KEPT:
            self.clear()
        n: dict[int, int] = {}
        for g in grams(token):
            b = self.bucket(g)
            n[b] = n.get(b, 0) + 1
        length = math.sqrt(sum(x * x for x in n.values()))
        self[token] = list(n), [x / length for x in n.values()]
        return self[token]


def _vectors(rows: Sequence[Sequence[str]], known: _Buckets) -> np.ndarray:
    """(rows, longest, dimension): each token's vector, zeros where a row has no more."""
    out = np.zeros((len(rows), max(map(len, rows)), known.dimension))
    starts, sizes, buckets, shares = [], [], [], []
    for i, tokens in enumerate(rows):
        start = i * out.shape[1] * known.dimension
        for j, t in enumerate(tokens):
            own, share = known[t]
            starts.append(start + j * known.dimension)
            sizes.append(len(own))
            buckets += own
            shares += share
    out.reshape(-1)[np.repeat(np.array(starts, np.int64), sizes) + np.array(buckets, np.int64)] = shares
    return out


def _weights(rows: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, w in enumerate(rows):
        out[i, : len(w)] = w
    return out


def _tiled(p: Sequence[str], r: Sequence[str], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The largest cosine of each token of p and of each of r, one tile of both at a time."""
    rows = max(1, BLOCK // known.dimension)
    best_p, best_r = np.zeros(len(p)), np.zeros(len(r))
    for a in range(0, len(p), rows):
        x = _vectors([p[a : a + rows]], known)[0]
        for b in range(0, len(r), rows):
            cosines = x @ _vectors([r[b : b + rows]], known)[0].T
            best_p[a : a + rows] = np.maximum(best_p[a : a + rows], cosines.max(axis=1))
            best_r[b : b + rows] = np.maximum(best_r[b : b + rows], cosines.max(axis=0))
    return best_p, best_r


def aligned(p: list[list[str]], wp: list[list[float]], r: list[list[str]], wr: list[list[float]], dimension: int = DIMENSION, known: _Buckets | None = None) -> np.ndarray:
    """Precision, recall and F1 of each pair of lists of distinct tokens with their weights, none empty."""
    known = _Buckets(dimension) if known is None else known
    out = np.zeros((len(p), 3))
    size = lambda i: max(len(p[i]), len(r[i]))
    order, at = sorted(range(len(p)), key=size), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * size(order[end]) * max(dimension, size(order[end])) <= BLOCK:
            end += 1
        own = order[at:end]
        at = end
        if len(own) == 1 and size(own[0]) * max(dimension, size(own[0])) > BLOCK:
            best = _tiled(p[own[0]], r[own[0]], known)
            best_p, best_r = best[0][None], best[1][None]
        else:
            cosines = _vectors([p[i] for i in own], known) @ _vectors([r[i] for i in own], known).transpose(0, 2, 1)
            best_p, best_r = cosines.max(axis=2), cosines.max(axis=1)  # cosines of counts are not negative, padding has zero
        for k, (best, w) in enumerate(((best_p, _weights([wp[i] for i in own])), (best_r, _weights([wr[i] for i in own])))):
            total = w.sum(axis=1)
            out[own, k] = np.divide((best * w).sum(axis=1), total, out=np.zeros(len(own)), where=total > 0)
    both = out[:, 0] + out[:, 1]
    out[:, 2] = np.divide(2 * out[:, 0] * out[:, 1], both, out=np.zeros(len(out)), where=both > 0)
    return out


def inverse_frequencies(texts: DataFrame, text_col: str) -> DataFrame:
    """(token, idf): log((n + 1) / (df + 1)) over the texts that aren't null."""
    tokens = texts.where(F.col(text_col).isNotNull()).select(F.array_distinct(V.embedding_tokens(F.col(text_col))).alias("t"))
    n = tokens.agg(F.count("*").alias("n"))
    found = tokens.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return found.join(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def _sides(pairs: DataFrame, key: str, frequencies: DataFrame | None) -> DataFrame:
    """(key, p, wp, r, wr): the distinct tokens of both texts with repeats times idf; tokens that no reference has weigh
    as if in none."""
    whole = pairs.where(F.col("pred").isNotNull() & F.col("ref").isNotNull())
    tokens = whole.select(key, *(V.embedding_tokens(F.col(c)).alias(c) for c in ("pred", "ref")))
    marked = lambda c, side: F.transform(c, lambda t: F.struct(F.lit(side).alias("side"), t.alias("token")))
    each = F.explode(F.concat(marked("pred", False), marked("ref", True)))
    counted = tokens.select(key, each.alias("x")).groupBy(key, "x.side", "x.token").agg(F.count("*").cast("double").alias("w"))
    if frequencies is not None:
        unseen = F.broadcast(frequencies.agg(F.max("idf").alias("_most")))
        counted = counted.join(frequencies, "token", "left").join(unseen).withColumn("w", F.col("w") * F.coalesce("idf", "_most", F.lit(1.0)))
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("token", "w"))))
    return counted.groupBy(key).agg(listed(False).alias("p"), listed(True).alias("r"))


def alignment(pairs: DataFrame, key: str = "key", frequencies: DataFrame | None = None, dimension: int = DIMENSION) -> DataFrame:
    """(key, precision, recall, f1) of pairs (key, pred, ref); keys are distinct. Pairs with a null text have no row.

    frequencies: (token, idf) as ``inverse_frequencies`` gives; a token that isn't there weighs as the rarest one.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def side(column: pa.ListArray) -> tuple[list[list[str]], list[list[float]]]:
        items, bounds = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))).tolist()
        names, weights = items.field("token").to_pylist(), items.field("w").to_pylist()
        cut = lambda x: [x[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        return cut(names), cut(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(dimension)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = aligned(*side(batch.column("p")), *side(batch.column("r")), dimension, known)
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(found[:, k]) for k in range(3))], names=[key, "precision", "recall", "f1"])

    return _sides(pairs, key, frequencies).mapInArrow(run, f"`{key}` {kind}, precision double, recall double, f1 double")


def stored_alignment(pairs: DataFrame, path: str, key: str = "key", frequencies: DataFrame | None = None) -> DataFrame:
    """The same, from a table of scores that is kept: only pairs whose key it lacks are scored, and appended to it.

    The key must stand for both texts and for whatever the frequencies come from.
    """
    spark = pairs.sparkSession
    distinct = pairs.dropDuplicates([key])
    new = distinct.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else distinct
    alignment(new, key, frequencies).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(distinct.select(key), key, "left_semi")


def alignment_f1(preds: list[str], refs: list[str], model: str = "", layers: int = 0) -> list[float]:
    """F1 of each pair of texts, all tokens weighing the same: a scorer as the evaluation takes it."""
    def tokens(text: str) -> Counter:
        found = [w for w in re.split(r"[\W_]+", unicodedata.normalize("NFC", text).lower()) if len(w) > 1]
        return Counter(found or [text])

    if not preds:
        return []
    sides = [[tokens(t) for t in texts] for texts in (preds, refs)]
    return aligned(*(f for side in sides for f in ([list(c) for c in side], [list(map(float, c.values())) for c in side])))[:, 2].tolist()


#: What stands for this scorer in the keys of a cache.
alignment_f1.cache_name = f"trigrams-{DIMENSION}"
