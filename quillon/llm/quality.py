"""Quality classifier by importance resampling (after Xie et al., "Data Selection via Importance Resampling", 2023).

Two generative models of hashed word n-grams are fitted: one on target texts (labelled good), one on the raw corpus (all
documents). A document's weight is the log ratio of their probabilities for its whole text. Gumbel noise, drawn from a
hash of the id, is added to the weight over ``temperature`` (one: untempered), and the k greatest sums are kept, which
samples k documents without replacement in proportion to their importance. By default k is the number of documents that
are more likely of the target than not: the share of the target in the corpus, as labelled, times a document's
importance is its chance, so the weight is held against minus the log of twice that share.

Texts become tokens (runs of letters or digits; runs of other characters). Two families of n-grams are hashed, into
BUCKETS each: unigrams and bigrams of the tokens, with repeats of the token before replaced by a mark and upper-case
words marked as such, and unigrams and bigrams of their shapes (lower, upper, title or mixed case, digits, or the
characters themselves), which few texts suffice to know. The target model reads at most FIT_DOCS documents that are
labelled good, those with the least hash of their id, and is drawn towards the raw model by pseudo-counts, so that what
few documents hold is no evidence. How many is decided by deleted estimation: each of those documents is weighed by the
counts of the others, FIT_DOCS documents labelled otherwise by all counts, and of SMOOTHS (pseudo-counts a target
n-gram) the one is taken that tells most of both kinds right, each kind counting one half. A document counts as told by
the logistic function of its margin, which is the chance that it stays on its side as noise is drawn for it and for a
document at the margin; ties at six decimals go to the larger. The raw model counts all documents, and scoring reads every document whole.

Counts and weights are one map stage each, without a shuffle of texts. The top k is found on the narrow rows (id and key)
by counting digits of the key, never by sorting or collecting rows.

Null text is the empty text, with weight zero like all texts without tokens. Documents with a null id get the noise of
the text "". Labels that are null are left out; documents labelled more than once count once, by their greatest label.
If no document is labelled good, or none otherwise, there is nothing to tell apart: all weights are zero and all
documents are kept. Repeated rows are kept or go together. Empty tables give empty results. Further columns are passed
through by ``keep_good`` and not read otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, read, slices, texts
from .topk import ordered_bits, top_k

BUCKETS = 1 << 14
#: Of both families.
SIZE = 2 * BUCKETS
#: Bound of the labelled sample, of either kind.
FIT_DOCS = 10_000
SMOOTHS = tuple(2.0**k for k in range(-6, 14))
TEMPERATURE = 1.0
SEED = 42
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SAME, UPPER, BEGIN = crc32(b"\x00same"), crc32(b"\x00upper"), crc32(b"\x00begin") >> 3
#: Tokens that a task remembers.
KEPT_TOKENS = 500_000


def shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:8]
    if token.isdigit():
        return "9"
    if token.islower():
        return "a"
    return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() and token[1:].islower() else "x"


class _Tokens(dict):
    """token -> its hash, its shape's hash and whether it is in upper case, in one number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        code = crc32(token.lower().encode("utf-8", "replace")) | (crc32(shape(token).encode("utf-8", "replace")) >> 3) << 32 | (token.isupper() and len(token) > 1) << 61
        self[token] = code
        return code


_TOKENS = _Tokens()


def _buckets(one: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    pairs = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (after * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = np.concatenate((one * np.uint64(0xFF51AFD7ED558CCD), pairs * np.uint64(0xFF51AFD7ED558CCD)))
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Bucket of each hashed unigram and bigram of tokens, then of shapes."""
    found = TOKEN.findall(text)
    if not found:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_TOKENS.__getitem__, found), np.uint64, len(found))
    h, shapes, upper = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32) & np.uint64(0x1FFFFFFF), codes >> np.uint64(61) > 0
    same = np.concatenate(([False], h[1:] == h[:-1]))
    h = np.where(same, np.uint64(SAME), np.where(upper, np.uint64(UPPER), h))
    before = np.concatenate((np.array([BEGIN], np.uint64), shapes[:-1]))
    return np.concatenate((_buckets(h, h[:-1], h[1:]), BUCKETS + _buckets(shapes, before, shapes)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """Log ratio of the target's to the raw model's probability of each bucket, and the target's share of the documents.

    What comes to the driver is two numbers a bucket, two a choice of pseudo-counts, and two counts.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("q")).where("doc_id is not null and q is not null").groupBy("doc_id").agg((F.max("q") > 0).alias("good"))
    seen = marks.agg(F.count_if("good").alias("good"), F.count("*").alias("all")).first()
    if not 0 < seen["good"] < seen["all"]:
        return np.zeros(SIZE), 1.0
    share = seen["good"] / seen["all"]
    sampled = lambda kind: marks.where(kind).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_docs)  # noqa: E731  a bounded sample
    chosen = cut(sampled("good").unionByName(sampled("not good")))
    schema = pa.schema([("good", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE), np.int64)  # of all, of the target
        for batch in slices(batches):
            for good, text in zip(batch.column("good").to_pylist(), texts(batch), strict=True):
                own = np.bincount(features(text), minlength=SIZE)
                sums[0] += own
                if good:
                    sums[1] += own
        good, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(good.astype(bool)), pa.array(bucket.astype(np.int32)), pa.array(sums[good, bucket])], schema=schema)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = arrow_map(source.join(F.broadcast(chosen), "doc_id", "left").select("good", "text"), count, schema)
    sums = np.zeros((2, SIZE))
    for r in counted.groupBy("good", "bucket").agg(F.sum("n").alias("n")).collect():
        sums[int(r.good), r.bucket] = r.n
    shared = docs.sparkSession.sparkContext.broadcast(sums)  # two numbers a bucket
    least = -math.log(2 * share)
    told = pa.schema([("good", pa.bool_()), ("choice", pa.int32()), ("right", pa.float64()), ("n", pa.int64())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros((2, len(SMOOTHS))), np.zeros(2, np.int64)
        for batch in slices(batches):
            for good, text in zip(batch.column("good").to_pylist(), texts(batch), strict=True):
                right[int(good)] += told_right(deleted_weights(features(text), *shared.value, good) - least, good)
                n[int(good)] += 1
        both = [(g, c) for g in (0, 1) for c in range(len(SMOOTHS))]
        yield pa.RecordBatch.from_arrays([pa.array([bool(g) for g, _ in both]), pa.array([c for _, c in both], pa.int32()), pa.array([right[g, c] for g, c in both], pa.float64()), pa.array([n[g] for g, _ in both], pa.int64())], schema=told)

    decided = arrow_map(source.join(F.broadcast(chosen), "doc_id").select("good", "text"), tell, told)
    found = {(r.good, r.choice): r.right / max(1, r.n) for r in decided.groupBy("good", "choice").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()}
    best = max(range(len(SMOOTHS)), key=lambda c: (round(found.get((False, c), 0) + found.get((True, c), 0), 6), c))
    return log_ratio(*sums, SMOOTHS[best]), share


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
    """The log ratio of the models from the counts of all documents and of the target; ``smooth`` pseudo-counts for each
    n-gram of the target are spread as in the raw model."""
    if not target.any():
        return np.zeros(len(raw))
    p = (raw + 1) / (raw + 1).sum()
    drawn = smooth * target.sum()
    return np.log((target + drawn * p) / (target.sum() + drawn) / p)


def told_right(margins: np.ndarray, good: bool) -> np.ndarray:
    """The chance that documents with these margins are told right, by the difference of two Gumbel draws."""
    return 0.5 + 0.5 * np.tanh((margins if good else -margins) / 2)


def deleted_weights(found: np.ndarray, raw: np.ndarray, target: np.ndarray, within: bool) -> np.ndarray:
    """The weight of a text with these n-grams for each of SMOOTHS; if it is one of the target's, by the counts of the others."""
    bucket, n = np.unique(found, return_counts=True)
    own = n if within else 0
    p, rest = (raw[bucket] + 1) / (raw.sum() + len(raw)), target.sum() - np.sum(own)
    drawn = np.array(SMOOTHS)[:, None] * target.sum()
    return np.log((target[bucket] - own + drawn * p) / (rest + drawn) / p) @ n


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight): the log importance of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            weights = [float(own[features(t)].sum()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights, pa.float64())], schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED, label_col: str = "quality") -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the k documents that are kept."""
    ratio, share = fit(docs, labels, label_col)
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    noisy = weigh(docs, ratio).withColumn("gumbel_key", F.col("log_weight") / F.lit(temperature) - F.log(-F.log(u)))
    scored = cut(noisy.withColumn("_key", ordered_bits(F.col("gumbel_key"))))
    if not ratio.any():
        return scored.drop("_key")
    if k is None:
        k = scored.where(F.col("log_weight") + F.lit(math.log(2 * share)) > 0).count()
    return top_k(scored, "_key", "doc_id", k).drop("_key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the resampling keeps; all columns stay. Rows with a null id stay."""
    kept = resample(docs, labels).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("bigint") == kept["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their weights and keys."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
