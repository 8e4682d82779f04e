"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Each shard scores a record from a hash of its key and the shard's name; the highest score takes it. With weight w the
score is w / -ln(u), u uniform in (0, 1) (Schindelhauer and Schomaker, 2005), so a shard receives rows in proportion to
its weight, and a new shard only takes rows, each with the probability of its share. One shard's score never depends on
another's, so no table of placements is kept.

Slots within a shard are numbered without gaps by two levels of counting: rows are numbered inside one of SUBS parts of
a shard, and the counts of the parts give each part its offset (shards x SUBS numbers, broadcast up to SENT of them). No
task ever sorts a whole shard. Equal rows are counted first and numbered as runs of at most RUN, each in a part of its
own, so that one row repeated any number of times is spread too.

The text is read once, by a map-side projection to its size and checksum; only these narrow rows are shuffled.

Null text has no bytes (size 8, checksum of the empty text). A null key is a key of its own. Repeated rows go to the
same shard and get different slots. Empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

#: Parts of a shard that are numbered separately.
SUBS = 1024
#: Offsets of parts that are broadcast; more are joined by shuffle.
SENT = 1 << 17
#: Equal rows that are numbered as one.
RUN = 10_000
#: Bytes of a record besides its text.
RECORD_BYTES = 8
LAW = "key"


def _score(key: Column, shard: str, weight: float) -> Column:
    """Weighted rendezvous score from 52 bits of a hash of key and shard name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: list[float], names: list[str] | None = None) -> Column:
    """The number of the shard that takes the key. names: stable names of the shards (default: their numbers)."""
    names = names or [str(i) for i in range(len(weights))]
    if not weights or len(names) != len(weights) or min(weights) <= 0:
        raise ValueError("each shard needs a name and a positive weight")
    scores = [F.struct(_score(key, n, w).alias("score"), F.lit(-i).alias("turn")) for i, (n, w) in enumerate(zip(names, weights, strict=True))]
    return -F.array_max(F.array(*scores))["turn"]


def with_slots(rows: DataFrame, shard: str, order: list[str], shards: int, subs: int = SUBS, run: int = RUN) -> DataFrame:
    """Adds slot, gapless from 0 in each of the shards; rows are ordered by part, then by ``order``."""
    columns = rows.columns
    equal = rows.groupBy(*columns).agg(F.count("*").alias("_all"))
    runs = equal.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / run)))).withColumn("_n", F.least(F.lit(run), F.col("_all") - F.col("_run") * run))
    parted = runs.withColumn("_part", F.pmod(F.xxhash64(*order, "_run"), F.lit(subs)).cast("int"))
    earlier = (Window.unboundedPreceding, -1)
    counts = parted.groupBy(shard, "_part").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(*earlier))
    offsets = counts.select(F.col(shard).alias("_shard"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.sum("_n").over(Window.partitionBy(shard, "_part").orderBy(*order, "_run").rowsBetween(*earlier))
    numbered = parted.withColumn("_at", F.coalesce(inside, F.lit(0)))
    offsets = F.broadcast(offsets) if shards * subs <= SENT else offsets
    joined = numbered.join(offsets, (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_p")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    return joined.select(*columns, (F.col("_offset") + F.col("_at")).alias("_start"), each.alias("_i")).select(*columns, (F.col("_start") + F.col("_i")).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each document, and its shard with one more shard (of weight one)."""
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight a shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = rows.withColumn("shard", shard_of(key, weights).cast("int")).withColumn("grown_shard", shard_of(key, [*weights, 1.0]).cast("int"))
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def op10_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight, by the law of the key."""
    return shard_documents(read(spark, sf_dir, "documents"), 24)
