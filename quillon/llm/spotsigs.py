"""SpotSigs document fingerprints (after Theobald, Siddharth and Paepcke, 2008).

Common words are anchors. Each anchor and the chain of CHAIN content words that follow it form a spot signature, hashed
to 64 bits; a document is its set of signatures. Texts with fewer than FEW signatures add their neighbouring word pairs,
and texts without words are their own single signature, so that short texts can be told apart. The fingerprint shows the
size of the set, a digest of the whole set, and its LEAST least hashes; likeness is the Jaccard index of the whole sets.

``near_pairs`` partitions the sets by length: sets of likeness t or more differ in length by a factor of at most 1/t, so
a set meets only its own band and the next. Within a band, sets are listed under the rarest of their signatures, as many
as a pair of likeness t must share one of. A pair is looked at under the first signature that both have only, and goes on
if the lengths, and what can still follow that signature, allow its likeness. Where few sets share a signature, pairs are
compared from the rarest signature on, and a comparison ends as soon as too few signatures are left. Where many do (a
group of near copies, whose links are all its pairs), they are dealt into blocks of bounded size, and the signatures in
common of all pairs of a block, or between two, are one matrix product.

``with_next`` finds each document's successor by id without a global sort in one task: ids are dealt into ranges of equal
numbers of documents, each a partition of its own, and the first document of each range is also sent, as a guest, to the
range before it.

Null text is the empty text (the empty set, alike only to another empty set). Null ids come before all others. Rows of
one id are ordered by a hash of their text; repeated rows follow each other. Empty tables give empty results. Only id
and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, join_classes, map_rows, partitions, read, slices, spark_ddl, texts

CHAIN = 2
FEW = 3
LEAST = 24
#: Signatures looked up between two tests whether enough are left.
STRETCH = 16
WORD = re.compile(r"[^\W_]+")
#: Kinds of characters between words up to which each is replaced by itself.
GAPS = 40

# Anchors, common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """the a an of to and in is it that was for on are as with be by at this from or have not but
    le la les un une des du de et en est que qui dans pour par sur au aux ce il elle ne pas
    der die das den dem ein eine und zu von mit ist im auf für sich nicht des werden
    el los las una y del al se por con para su es lo como""".split()
)


def words(text: str) -> list[str]:
    """What WORD finds; where few kinds of characters lie between words, they are made spaces, which is faster."""
    gaps = [c for c in set(text) if not c.isalnum()]
    if len(gaps) > GAPS:
        return WORD.findall(text)
    for c in gaps:
        text = text.replace(c, " ")
    return text.split()


def signatures(text: str) -> set[int]:
    """The text's set of hashed spot signatures."""
    found = words(text.lower())
    if not found:
        return {xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1)} if text else set()
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in found:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    chains = {" ".join((a, *content[k : k + CHAIN])) for a, k in spots if k + CHAIN <= len(content)}
    if len(chains) < FEW:
        chains |= {f"\n{x} {y}" for x, y in zip(found, found[1:], strict=False)} or {f"\n{found[0]}"}
    return set(map(xxhash.xxh64_intdigest, chains))


def fingerprint(signs: set[int]) -> str:
    order = np.sort(np.fromiter(signs, np.uint64, len(signs)))
    return f"{len(order):x}.{xxhash.xxh64_hexdigest(order.astype('<u8').tobytes())}." + "".join(f"{x >> 32:08x}" for x in order[:LEAST].tolist())


def likeness(a: set[int], b: set[int], least: float = 0.0) -> float:
    """The Jaccard index, or 0 where the lengths alone show that it is below ``least``."""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, schema: pa.Schema, make, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``make(doc_id, text, next text)`` for each document, as rows of ``schema``; the last one is followed by the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("double"))
    ranges = 2 * partitions(spark)
    marks = rows.select("_id").stat.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    splits = [-float("inf"), *sorted(set(marks or [0.0])), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="_range").transform(rows)
    # one row a range
    firsts = sorted((r["_range"], r["first"]) for r in dealt.groupBy("_range").agg(F.min("_id").alias("first")).collect())
    schema_ = "_range double, _first double, _before double"
    guests = spark.createDataFrame([(r, f, firsts[k - 1][0]) for k, (r, f) in enumerate(firsts)], schema_)
    sent = dealt.join(F.broadcast(guests), "_range").select(
        "doc_id",
        "text",
        F.explode(F.when(F.col("_id") == F.col("_first"), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))))).alias("to"),
    )
    ordered = sent.select("doc_id", "text", "to.r", "to.guest").withColumn("r", F.col("r").cast("int")).repartitionById(len(splits) - 1, "r").sortWithinPartitions("r", "guest", "doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, doc_id, text) whose successor hasn't come yet
        for batch in slices(batches):
            out = []
            for r, guest, doc, text in zip(batch.column("r").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if waiting is not None and waiting[0] == r:
                    out.append(make(waiting[1], waiting[2], text))
                waiting = None if guest else (r, doc, text)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return arrow_map(ordered, run, schema)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next text."""
    last: list = [None, set()]

    def make(doc, text: str, following: str):
        own = last[1] if last[0] == text else signatures(text)
        last[:] = [following, signatures(following)]
        changed = edited(text, following)
        other = signatures(changed)
        return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, last[1])

    return with_next(docs, RESULT, make)


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signs): the signature set of each whole text, as sorted signed longs."""
    schema = pa.schema([("doc_id", pa.int64()), ("signs", pa.list_(pa.int64()))])
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = lambda s: np.sort(np.fromiter(s, np.uint64, len(s)).astype(np.int64))
    return map_rows(source, schema, lambda b: {"doc_id": b.column("doc_id").to_pylist(), "signs": [signed(signatures(t)) for t in texts(b)]})


def pruned_likeness(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """The Jaccard index of two sets given as sorted numbers, or 0 where it is below ``least``.

    Stretches of the shorter set are looked up in the longer one, and what is left must be able to make up the rest.
    """
    if len(x) > len(y):
        x, y = y, x
    need = math.ceil(least / (1 + least) * (len(x) + len(y)) - 1e-9)
    if not len(x) or len(x) < need:
        return float(least <= 0 or not len(y))
    both, at = 0, 0
    for k in range(0, len(x), STRETCH):
        if both + len(x) - k < need or both + len(y) - at < need:
            return 0.0
        part = x[k : k + STRETCH]
        places = np.searchsorted(y[at:], part) + at
        inside = places < len(y)
        both += int((y[places[inside]] == part[inside]).sum())
        at = int(places[-1])
    return both / (len(x) + len(y) - both) if both >= need else 0.0


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())])
#: Classes that share a signature, at most, whose pairs are made one by one; classes, and signatures, of a block of more.
HOLDERS, BLOCK, BLOCK_SIGNS = 16, 1000, 1 << 20
#: Columns of a dense product; share of a block's sets, at least, that have a signature of such a column.
COLUMNS, WIDE = 2048, 16


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets have in common, above the diagonal.

    Numbers that many of the sets have are columns of a matrix product; of the others the few holders are paired.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, held = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    wide = held >= max(2, m // WIDE)
    place = np.cumsum(wide) - 1
    inside = wide[column]
    rows, columns = owner[inside], place[column[inside]]
    for k in range(0, int(wide.sum()), COLUMNS):
        x = np.zeros((m, COLUMNS), np.float32)
        here = (columns >= k) & (columns < k + COLUMNS)
        x[rows[here], columns[here] - k] = 1
        out += x @ x.T
    few = ~inside & (held[column] > 1)
    order = np.lexsort((owner[few], column[few]))
    rows, columns = owner[few][order], column[few][order]
    for k in range(1, int(held[~wide].max(initial=0))):
        same = np.flatnonzero(columns[k:] == columns[:-k])
        np.add.at(out, (rows[same], rows[same + k]), 1)
    return out


def block_pairs(key: tuple, table: pa.Table, least: float) -> pa.Table:
    """The near pairs of one block of holders, or between two, for which the block's signature is the first in common."""
    columns = {c: table.column(c).to_numpy() for c in ("class_id", "n", "at", "guest", "part")}
    order = np.lexsort((columns["class_id"], columns["n"]))
    ids, n, at, guest, part = (columns[c][order] for c in ("class_id", "n", "at", "guest", "part"))
    lists = lambda c: [(x := table.column(c).combine_chunks())[int(k)].values.to_numpy() for k in order]
    total = n[:, None] + n[None, :]
    after = n - at
    fits = np.triu(np.ones((len(n), len(n)), bool), 1) & (guest == 0)[None, :] & (n[:, None] >= least * n[None, :])
    fits &= np.minimum(after[:, None], after[None, :]) >= least / (1 + least) * total - 1e-9
    i, j = key[2].as_py(), key[3].as_py()
    if i != j:
        fits &= part[:, None] != part[None, :]
    if fits.any():
        fits &= common(lists("earlier")) == 0
    if not fits.any():
        return PAIR.empty_table()
    both = common(lists("signs"))
    likeness = both / (total - both).astype(np.float64)
    rows, cols = np.nonzero(fits & (both >= np.ceil(least / (1 + least) * total - 1e-9)) & (likeness >= least))
    return pa.table([ids[rows], ids[cols], likeness[rows, cols]], schema=PAIR)


def near_pairs(docs: DataFrame, least: float = 0.8, holders: int = HOLDERS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes of equal sets with a likeness of ``least`` or more, and (doc_id, class_id).

    A class is named by its least id. Copies are not expanded into pairs. Null ids are left out.
    """
    sets = cut(signature_sets(docs.where(F.col("doc_id").isNotNull())).withColumn("set_id", F.xxhash64("signs", F.sha2(F.to_json("signs"), 256))))
    classes = sets.groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.first("signs").alias("signs"))
    classes = cut(classes.select("set_id", "class_id", "signs", F.size("signs").alias("n")))
    membership = join_classes(sets.select("doc_id", "set_id"), classes.select("set_id", "class_id"), "set_id", "inner").select("doc_id", "class_id")
    classes = classes.where("n > 0").drop("set_id")
    listed = classes.select("class_id", "n", F.explode("signs").alias("s"))
    # signatures of one class come first in its order, and no pair meets there: they are counted, not listed
    spread = listed.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = listed.join(spread.hint("shuffle_hash"), "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    prefix = F.expr(f"slice(x, 1, greatest(0, n - cast(ceil({least} * n - 1e-9) as int) + 1 - (n - size(x))))")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(least)) + 1e-9)
    entries = cut(shared.select("class_id", "n", band.alias("band"), F.size("x").alias("k"), F.posexplode(prefix).alias("at", "y")).select("class_id", "n", "band", (F.col("n") - F.col("k") + F.col("at")).alias("at"), "y.df", "y.s"))
    # of signatures that the same classes have, only the first can be the first that two of them have in common
    groups = entries.groupBy("s").agg(F.min("df").alias("df"), F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("class_id")).alias("h"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("g"))
    groups = groups.where("m > 1").groupBy("m", "size", "h", "g").agg(F.min(F.struct("df", "s"))["s"].alias("s"))
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("size") / BLOCK_SIGNS)).cast("int")
    entries = cut(entries.join(groups.select("s", "m", parts.alias("parts")).hint("shuffle_hash"), "s"))
    firsts = entries.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("order"))
    kept = entries.join(firsts, "class_id")
    few = kept.where(F.col("m") <= holders)
    left = few.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("order").alias("order_a"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "s")
    right = few.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("order").alias("order_b"), "band", "s")
    fits = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # of the pair's first common signature, which the rarest-first order makes the same for both: all that can follow it
    follows = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    first = F.element_at(F.array_intersect("order_a", "order_b"), 1) == F.col("s")
    met = left.join(right, ["band", "s"]).where(fits & (F.col("n_a") >= F.lit(least) * F.col("n_b")) & follows).where(first).select("a", "b")
    with_sets = met.join(classes.select(F.col("class_id").alias("a"), F.col("signs").alias("x")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("signs").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [(batch.column("x")[k].values.to_numpy(), batch.column("y")[k].values.to_numpy()) for k in range(batch.num_rows)]
            found = np.array([pruned_likeness(x, y, least) for x, y in sets])
            keep = pa.array(np.flatnonzero(found >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(found).take(keep)], schema=PAIR)

    earlier = F.slice("order", 1, F.array_position("order", F.col("s")).cast("int") - 1)
    many = kept.where(F.col("m") > holders).select("class_id", "n", "at", "s", earlier.alias("earlier"), "parts", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"), F.posexplode(F.array("band", F.col("band") + 1)).alias("guest", "band"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("class_id", "n", "at", "s", "earlier", "part", "guest", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocks = many.join(classes.select("class_id", "signs"), "class_id").groupBy("s", "band", "i", "j")
    in_blocks = blocks.applyInArrow(lambda key, table: block_pairs(key, table, least), spark_ddl(PAIR))
    return arrow_map(with_sets, run, PAIR).unionByName(in_blocks), membership


def spotsigs_near_pairs(spark, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links): each document's class of equal signature sets, and how many other classes are near it."""
    pairs, members = near_pairs(read(spark, sf_dir, "documents"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return join_classes(cut(members), ends, "class_id").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op5_spotsigs_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
