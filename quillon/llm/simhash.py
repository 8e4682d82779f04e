"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32. Fingerprints that differ in ``distance`` <= 3 bits differ in at
most one bit of one segment, so each is filed under its two segment values and looked up under every value of a Hamming
ball of radius one around them. Of two values that differ in one bit, one has the bit set, so only set bits need be
cleared for the probes. Matches are verified on the whole 64 bits.

Only distinct fingerprints are indexed, each with the least id of its documents: copies, however many, are one entry.
A segment value that very many distinct fingerprints share is looked up under its other half too (``_refined``): the
other segment is cut in two and at least one of these quarters also lies in a ball of radius one. So crowded values
don't pair all their members.

Fingerprints, links and components stay distributed. Null text is the empty text; texts without words have fingerprint
zero and are linked like any other. Rows with a null id are fingerprinted but have no component (null). Repeated rows
give repeated results. Empty tables give empty results. Only id and text are read.

The pipeline's stage (``keep_one``) drops what these components drop. Most edited copies differ in more bits than small
balls reach, so it also links documents by the likeness of their whole texts' shingle sets, of which MinHash bands find
the candidates.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes, map_rows, raw_texts, read
from .components import components

SEED = 42
#: Fingerprints per segment value above which the value is looked up together with a part of the other segment.
CROWDED = 128
#: Shingles hashed at once.
CHUNK = 100_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over the XXH64 of word shingles: a bit is one if it is set in over half of the hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), ">u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, schema, lambda b: {"doc_id": b.column("doc_id").to_pylist(), "fp": [fingerprint(t, width) for t in raw_texts(b)]})


def _half(fp, seg: int):
    return F.shiftrightunsigned(fp, 32) if seg == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _cleared(value, bits: int):
    """The value and the value without each one of its set bits, as (v, flips)."""
    return F.concat(
        F.array(F.struct(value.alias("v"), F.lit(0).alias("flips"))),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftright", value, i)) == 1),
            lambda i: F.struct((value - F.call_function("shiftleft", F.expr("1L"), i)).alias("v"), F.lit(1).alias("flips")),
        ),
    )


def _met(probe: DataFrame, table: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Verified links (a, b) of probes and table entries with equal keys; probes without a flip meet greater ones only."""
    return (
        probe.join(table, keys)
        .where((F.col("flips") > 0) | (F.col("a") < F.col("b")))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )


def _refined(probe: DataFrame, table: DataFrame, distance: int) -> DataFrame:
    """Links below crowded segment values: the other segment's quarters narrow them down in the same way."""

    def other(side: str):
        fp = F.col(side)
        return F.when(F.col("seg") == 0, _half(fp, 1)).otherwise(_half(fp, 0))

    def quarters(side: str):
        x = other(side)
        return F.array(F.struct(F.lit(0).alias("q"), F.shiftright(x, 16).alias("w")), F.struct(F.lit(1).alias("q"), x.bitwiseAND(F.lit(0xFFFF)).alias("w")))

    entries = table.select("seg", "v", "b", F.explode(quarters("b")).alias("x")).select("seg", "v", "b", "x.q", F.col("x.w").alias("w"))
    asked = probe.select("seg", "v", "flips", "a", F.explode(quarters("a")).alias("x"))
    # here either side of a pair may hold the set bit of the quarter, so a full ball is looked up
    ball = F.concat(F.array(F.col("x.w")), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("x.w").bitwiseXOR(F.call_function("shiftleft", F.expr("1L"), i))))
    asked = asked.select("seg", "v", "flips", "a", F.col("x.q").alias("q"), F.explode(ball).alias("w"))
    return _met(asked, entries, ["seg", "v", "q", "w"], distance)


def links(fps: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a > b: all pairs of distinct fingerprints (column fp, distinct) that differ in 1 to ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one cover up to three bits")
    fp = F.col("fp")
    halves = F.array(*(F.struct(F.lit(s).alias("seg"), _half(fp, s).alias("v")) for s in (0, 1)))
    table = fps.select(fp.alias("b"), F.explode(halves).alias("x")).select("b", "x.seg", "x.v")
    probe = (
        fps.select(fp.alias("a"), F.explode(halves).alias("x"))
        .select("a", F.col("x.seg").alias("seg"), F.explode(_cleared(F.col("x.v"), 32)).alias("y"))
        .select("a", "seg", F.col("y.v").alias("v"), F.col("y.flips").alias("flips"))
    )
    heavy = cut(table.groupBy("seg", "v").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("seg", "v"))
    if heavy.isEmpty():
        return _met(probe, table, ["seg", "v"], distance).distinct()
    light = _met(probe.join(heavy, ["seg", "v"], "left_anti"), table.join(heavy, ["seg", "v"], "left_anti"), ["seg", "v"], distance)
    dense = _refined(probe.join(heavy, ["seg", "v"], "left_semi"), table.join(heavy, ["seg", "v"], "left_semi"), distance)
    return light.unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id): the component is the least id reachable over links, the document's own included."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = components(links(classes.select("fp"), distance, crowded))
    own = classes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = own.join(least, "root").select("fp", "component_id")
    return join_classes(marked, named, "fp", "inner").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Near-copies share at least this part (Jaccard) of their distinct shingles of SHINGLE words.
LIKENESS, SHINGLE = 0.8, 5
#: Bands of BAND least hashes each. Of pairs at a likeness of 0.8 all but (1 - 0.8^4)^24 = 3 in a million share a band.
BANDS, BAND = 24, 4
#: Documents up to which a group of candidates is compared whole; larger ones are dealt into blocks.
GROUP = 2000
#: Bytes of shingle sets up to which that holds; postings that are walked at once.
GROUP_BYTES, WALKED = 32 << 20, 1 << 20
FACTORS = np.random.default_rng(SEED).integers(2**63, size=(BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def bands(signs: np.ndarray) -> list[int]:
    """A MinHash key for each band; none for the empty set."""
    if not len(signs):
        return []
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(signs), 4096):
        least = np.minimum(least, (FACTORS * signs[at : at + 4096]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND).T:
        keys = _mixed(keys + part)
    return keys.astype(np.int64).tolist()


def verified(sets: list[np.ndarray], least: float = LIKENESS) -> list[int]:
    """For each set the place of the first that it reaches over pairs of a Jaccard index of ``least`` or more.

    A set is compared with those not reached yet only, so a group of copies takes few comparisons.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.cumsum(sizes)
    root = np.full(len(sets), -1)
    left = len(sets)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], waiting, left = first, [first], left - 1
        while waiting and left:
            x = waiting.pop()
            own = code[ends[x] - sizes[x] : ends[x]]
            both, step = np.zeros(len(sets), np.int64), max(1, WALKED // len(sets))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                many = starts[part + 1] - starts[part]
                at = np.repeat(starts[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
                both += np.bincount(holders[at], minlength=len(sets))  # a set holds a shingle once
            near = np.flatnonzero((root < 0) & (both >= least * (sizes[x] + sizes - both) - 1e-9))
            root[near] = first
            left -= len(near)
            waiting += near.tolist()
    return root.tolist()


SIGNED = pa.schema([("first", pa.int64()), ("groups", pa.list_(pa.int64())), ("signs", pa.binary())])


def _compared(keyed: DataFrame, source: DataFrame) -> DataFrame:
    """(grp, a, b): for each member (first, h, grp) of a group the least id that it reaches over likenesses inside it."""
    asked = keyed.groupBy("first", "h").agg(F.collect_set("grp").alias("groups"))
    candidates = source.withColumnRenamed("doc_id", "first").join(asked, ["first", "h"]).select("first", "groups", "text")

    def signed(batch: pa.RecordBatch) -> dict[str, list]:
        return {c: batch.column(c).to_pylist() for c in ("first", "groups")} | {"signs": [shingles(t).tobytes() for t in raw_texts(batch)]}

    def held(found: pa.Table) -> pa.Table:
        ids = sorted(range(found.num_rows), key=(first := found.column("first").to_pylist()).__getitem__)
        signs = found.column("signs")
        root = verified([np.frombuffer(signs[i].as_buffer(), np.uint64) for i in ids])
        own = pa.array([found.column("grp")[0].as_py()] * len(ids), pa.int64())
        return pa.table({"grp": own, "a": pa.array([first[i] for i in ids], pa.int64()), "b": pa.array([first[ids[r]] for r in root], pa.int64())})

    sent = map_rows(candidates, SIGNED, signed).select("first", F.explode("groups").alias("grp"), "signs")
    return sent.dropDuplicates(["first", "grp"]).groupBy("grp").applyInArrow(held, "grp bigint, a bigint, b bigint")


def _blocks(n: Column, size: Column, group: int) -> Column:
    """Blocks for n documents whose sets have ``size`` bytes together."""
    return F.greatest(F.ceil(n / group), F.ceil(size / GROUP_BYTES)).cast("int")


def _in_blocks(met: DataFrame, source: DataFrame, group: int) -> DataFrame:
    """(a, b): links among the members of bands, rows (band, first, h, size, least, n, bytes), of which some have more than
    ``group`` documents or GROUP_BYTES.

    Such a band is dealt into blocks, and its least member goes into each of them. Members that reach it inside their
    block are one component already; only the others are held against all blocks, in blocks of their own. So no task
    holds much more than twice ``group`` documents or GROUP_BYTES, and a band of copies of one document costs each of them one comparison.
    """
    dealt = met.withColumn("count", _blocks(F.col("n"), F.col("bytes"), group)).withColumn("block", F.pmod(F.xxhash64("first"), F.col("count")).cast("int"))
    every = F.when(F.col("first") == F.col("least"), F.sequence(F.lit(0), F.col("count") - 1)).otherwise(F.array("block"))
    dealt = cut(dealt)
    keyed = dealt.select("first", "h", "band", F.explode(every).alias("block")).select("first", "h", F.xxhash64("band", "block").alias("grp"))
    inside = cut(_compared(keyed, source))
    left = dealt.where("count > 1").withColumn("grp", F.xxhash64("band", "block")).join(inside.withColumnRenamed("a", "first"), ["grp", "first"]).where("b <> least")
    left = cut(left.select("band", "first", "h", "size", "count"))
    links = inside.select("a", "b")
    if left.isEmpty():
        return links
    rows = left.groupBy("band").agg(_blocks(F.count("*"), F.sum("size"), group).alias("own"))
    own = left.join(rows, "band").withColumn("u", F.pmod(F.xxhash64("first", F.lit(1)), F.col("own")).cast("int"))
    others = dealt.join(rows, "band").select("first", "h", "band", "block", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("u"))
    asking = own.select("first", "h", "band", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("block"), "u")
    keyed = others.unionByName(asking).select("first", "h", F.xxhash64("band", "block", "u").alias("grp"))
    return links.unionByName(_compared(keyed, source).select("a", "b"))


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id) of documents that copy one another, edited ones included.

    Two documents are linked if their sets of five-word shingles, those of the whole texts, have a Jaccard index of 0.8
    or more. Documents that share a MinHash band are only candidates: groups of them (one document for each distinct
    set) are held against each other on the sets themselves. A group of up to ``group`` documents and GROUP_BYTES of sets
    goes to one task, a larger one band by band, and those bands in blocks of that size. Copies of a set are named once
    it has its component, so they are no links. An id whose rows have several sets links these. Rows with a null id are
    left out.
    """
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).where("doc_id is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("set_id", pa.string()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        sets = [shingles(t) for t in raw_texts(batch)]
        own = {c: batch.column(c).to_pylist() for c in ("doc_id", "h")}
        return own | {"set_id": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "size": [s.nbytes for s in sets], "bands": [bands(s) for s in sets]}

    marked = cut(map_rows(source, schema, make))
    # a set is found in the document of the least id that has it
    classes = cut(marked.groupBy("set_id").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("set_id", F.col("x.doc_id").alias("first"), F.col("x.h").alias("h"), "size", "bands"))
    named = cut(join_classes(marked.select("doc_id", "set_id"), classes.select("set_id", "first"), "set_id", "inner").select("doc_id", "first"))
    several = cut(named.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("doc_id", "a"))
    same = named.join(several, "doc_id").where("first <> a").select("a", F.col("first").alias("b")).distinct()

    listed = classes.select("first", "h", "size", F.explode("bands").alias("band"))
    shared = listed.groupBy("band").agg(F.min("first").alias("least"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    met = cut(join_classes(cut(listed), shared, "band", "inner"))
    rooted = cut(components(met.select(F.col("first").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "first"))
    sizes = met.select("first", "size").distinct()
    large = cut(rooted.join(sizes, "first").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > group) | (F.col("bytes") > GROUP_BYTES)).select("root", F.lit(True).alias("large")))
    if large.isEmpty():
        near = _compared(met.join(rooted, "first").select("first", "h", F.col("root").alias("grp")), source).select("a", "b")
    else:
        placed = cut(met.join(join_classes(rooted, large, "root"), "first"))
        small = placed.where("large is null").select("first", "h", F.col("root").alias("grp"))
        near = _compared(small, source).select("a", "b").unionByName(_in_blocks(placed.where("large").select("band", "first", "h", "size", "least", "n", "bytes"), source, group))
    linked = components(same.unionByName(near.where("a <> b"))).withColumnRenamed("node", "first")
    rooted = classes.select("first").distinct().join(linked, "first", "left").select("first", F.coalesce("root", "first").alias("root"))
    return join_classes(named, cut(rooted), "first", "inner").groupBy("doc_id").agg(F.min("root").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the least of their component by fingerprints, and of that by likeness; all columns stay.

    So of two documents that either links one stays at most, and whatever goes leads, by ever smaller ids, to one that
    stays. Of repeated rows with one id, all stay or go together. Rows with a null id stay.
    """
    rooted = near_duplicates(docs).select("doc_id", "component_id").unionByName(near_copies(docs))
    dropped = rooted.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs["doc_id"].cast("bigint") == dropped["_dropped"], "left_anti")


def op9_simhash_multi_index(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
