"""Two tables in files by the same bucket numbers, one sorted Parquet file for each table and bucket.

Files are refined as in a multi-level radix partitioning: the number of a row's file is written in digits of base
``fanout``, and each pass but the last reads the files of the one before and splits each of them by one more digit, so
that no task of a pass has rows for more than ``fanout`` files of each file it reads (Spark's writer sorts them by digit
and has one file open). Passes need no shuffle, and a hot number stays spread over as many files as there are tasks. The
last digit is resolved by the leaf tasks: an exchange by number, to which a task that reads files of one prefix adds at
most ``fanout`` blocks; every leaf task sorts the rows of one number (Spark's sort, which spills) and writes one file.

``rewrite`` first counts, from the key column alone, how many rows each starting file has for each bucket. A starting
file whose rows all go to one bucket, which has no other rows, is that bucket's file already and stays; the others are
read, rewritten and, once the new files are there, deleted. Keys of a detail row that no head row has are found by an
equi-join of narrow rows; they go to a bucket of their own, and null keys (of either table) to another.

Nothing that grows with the rows goes to the driver: it gets the names of files, of which a table has ``buckets`` + 2 at
most. The file of a hot key is written whole by one task, as one file for each bucket is asked for. Files are committed
by Spark's protocol, so lost tasks are run again; a call that breaks off leaves its starting files, and the next call
uses a new folder.

Nulls sort first in every column, strings by their bytes. Repeated rows stay. Empty tables have no files. Columns that
have the names used here (``layout``, ``_number``, ``_prefix``) are refused. Further columns are kept in their order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, cut, read, shared_folder

BUCKETS = 600
FANOUT = 25
#: Bytes that are handed to the digest at once.
DIGEST_BYTES = 1 << 20
OWN = {"layout", "_number", "_prefix", "_tag"}


def digits(numbers: int, fanout: int) -> int:
    """Digits of base ``fanout`` that tell ``numbers`` numbers apart, one at least."""
    if fanout < 2:
        raise ValueError("a pass splits files in two at least")
    n = 1
    while fanout**n < numbers:
        n += 1
    return n


def layout(tag: str, number: Column) -> Column:
    """Name of a file's folder: a letter for the kind of file, and its number."""
    return F.coalesce(F.concat(F.lit(tag), F.lpad(number.cast("string"), 5, "0")), F.lit(""))  # never null: no sort is added


def write_files(rows: DataFrame, number: Column, numbers: int, tag: str, columns: list[str], folder: str, work: str, fanout: int = FANOUT) -> None:
    """Adds one sorted file for each ``number`` (0 to ``numbers`` - 1) below ``folder``; works in new folders of ``work``."""
    spark = rows.sparkSession
    held = rows.select(*columns, number.cast("int").alias("_number"))
    for level in range(1, digits(numbers, fanout)):
        prefix = F.floor(F.col("_number") / fanout ** (digits(numbers, fanout) - level)).cast("int")
        path = f"{work}/{tag}-{level}"
        held.withColumn("_prefix", prefix).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("_prefix").parquet(path)
        if not _folders(spark, path):
            return
        held = spark.read.schema(held.schema).parquet(path)
    leaves = held.repartitionById(numbers, F.col("_number")).select(*columns, layout(tag, F.col("_number")).alias("layout"))
    key, *rest = columns
    ordered = leaves.sortWithinPartitions("layout", key, *rest)
    ordered.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("layout").parquet(folder)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    p, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Pair:
    """Heads (one key each, as a rule) and details that refer to them by the same key, which is the first column of both."""

    key: str
    buckets: int = BUCKETS
    salt: str = "s"
    fanout: int = FANOUT

    @property
    def orphan(self) -> int:
        """The bucket of details whose key no head has; that of null keys is the next one."""
        return self.buckets

    @property
    def numbers(self) -> int:
        return self.buckets + 2

    def bucket(self) -> Column:
        """A row's bucket, from its key and ``_orphan`` (null or not)."""
        own = F.crc32(F.concat(F.lit(self.salt), F.col(self.key).cast("string"))) % self.buckets
        return F.when(F.col(self.key).isNull(), self.orphan + 1).when(F.col("_orphan").isNotNull(), self.orphan).otherwise(own).cast("int")


def write_start(rows: DataFrame, number: Column, numbers: int, folder: str, work: str, fanout: int = FANOUT) -> None:
    """A table in numbered files, sorted by all columns from the left."""
    if taken := OWN & set(rows.columns):
        raise ValueError(f"these columns are used here: {sorted(taken)}")
    write_files(rows, number, numbers, "s", rows.columns, folder, work, fanout)


def tallies(start: DataFrame, key: str) -> DataFrame:
    """(layout, key, n): rows by starting file and key, in the shared folder. Only the key column is read."""
    return cut(start.groupBy("layout", key).agg(F.count("*").alias("n")))


def moves(tally: DataFrame, orphans: DataFrame | None, pair: Pair) -> DataFrame:
    """(start, bucket, n): how many rows of each starting file go to each bucket."""
    known = tally.withColumn("_orphan", F.lit(None).cast("boolean")) if orphans is None else tally.join(orphans, pair.key, "left")
    return cut(known.groupBy(F.substring("layout", 2, 9).cast("int").alias("start"), pair.bucket().alias("bucket")).agg(F.sum("n").alias("n")))


def staying(moved: DataFrame) -> dict[int, int]:
    """Starting files that are a bucket's file already: all their rows go there, and no others do. start -> bucket."""
    one_bucket = moved.groupBy("start").agg(F.count("*").alias("k"), F.min("bucket").alias("bucket")).where("k = 1").select("start", "bucket")
    one_start = moved.groupBy("bucket").agg(F.count("*").alias("k")).where("k = 1").select("bucket")
    return {r.start: r.bucket for r in one_bucket.join(one_start, "bucket").collect()}  # a row a bucket at most


def rewrite(start: DataFrame, columns: list[str], orphans: DataFrame | None, stay: dict[int, int], pair: Pair, folder: str, work: str) -> None:
    """Rewrites all starting files but those that stay, and deletes them."""
    spark = start.sparkSession
    names = {f"s{s:05d}" for s in stay}
    old = [x.removeprefix("layout=") for x in _folders(spark, folder)]
    gone = [x for x in old if x not in names]
    if gone:
        rows = start.where(F.col("layout").isin(gone))
        rows = rows.withColumn("_orphan", F.lit(None).cast("boolean")) if orphans is None else rows.join(orphans, pair.key, "left")
        write_files(rows, pair.bucket(), pair.numbers, "b", columns, folder, work, pair.fanout)
    for x in gone:
        _delete(spark, f"{folder}/layout={x}")


def ids_digests(counted: DataFrame, by: list[str], key: str) -> DataFrame:
    """SHA-256 of each file's keys in order, comma-joined, null empty.

    counted: (by..., key, n) with a key's n equal rows in one row; a file's rows stream through one task in order, and a
    run of equal keys is never spread out.
    """
    schema = pa.schema([*((c, pa.string()) for c in by), ("ids_sha256", pa.string())])
    ordered = counted.select(*by, F.col(key).cast("string").alias("_text"), "n", F.col(key).alias("_key")).repartition(*by).sortWithinPartitions(*by, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, first = None, None, True

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in now), pa.array([sha.hexdigest()])], schema=schema)

        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            for name, text, n in zip(names, batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), strict=True):
                if name != now:
                    if sha:
                        yield ended()
                    now, sha, first = name, hashlib.sha256(), True
                one = b"," + (text or "").encode()
                if first:
                    sha.update(one[1:])
                    n, first = n - 1, False
                at_once = max(1, DIGEST_BYTES // len(one))
                for _ in range(n // at_once):
                    sha.update(one * at_once)
                sha.update(one * (n % at_once))
        if sha:
            yield ended()

    return arrow_map(ordered.select(*by, "_text", "n"), run, schema)


def report(spark: SparkSession, folders: dict[str, str], moved: dict[str, DataFrame], stay: dict[str, dict[int, int]], pair: Pair) -> DataFrame:
    """One row for each final file, from the files themselves and from where their rows were before."""
    parts, lines, stayed = [], [], []
    for name, folder in folders.items():
        if not _folders(spark, folder):
            continue
        found = spark.read.parquet(folder)
        columns = [c for c in found.columns if c != "layout"]
        at = F.lit(name).alias("table_name")
        parts.append(found.groupBy(at, F.col("layout"), F.col("_metadata.file_path").alias("path"), F.col(pair.key).cast("bigint").alias("_id")).agg(F.count("*").alias("n")).withColumn("columns", F.lit(",".join(columns))))
        lines.append(moved[name].select(at, "start", "bucket", "n"))
        stayed += [(name, f"s{s:05d}", b) for s, b in stay[name].items()]
    if not parts:
        return spark.createDataFrame([], "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    known = spark.createDataFrame(stayed, "table_name string, layout string, _bucket int")  # as many as buckets
    counted = union(parts).join(F.broadcast(known), ["table_name", "layout"], "left")
    counted = cut(counted.withColumn("bucket", F.coalesce("_bucket", F.substring("layout", 2, 9).cast("int")).cast("bigint")).withColumn("rewritten", F.col("_bucket").isNull()).drop("_bucket"))
    files = counted.groupBy("table_name", "bucket", "path", "columns", "rewritten").agg(F.sum("n").alias("n_rows"))
    # rows of the inner join on the key: by key, the product of both tables' counts
    heads, details = list(folders)
    sides = counted.where("_id is not null").groupBy("bucket", "_id").agg(*(F.coalesce(F.sum(F.when(F.col("table_name") == t, F.col("n"))), F.lit(0)).alias(c) for t, c in ((heads, "_a"), (details, "_b"))))
    joined = sides.groupBy("bucket").agg(F.sum(F.col("_a") * F.col("_b")).alias("n_joined"))
    starts = F.transform(F.array_sort(F.collect_list(F.struct("start", "n"))), lambda x: F.concat_ws(":", x["start"], x["n"]))  # starting files of one bucket: as many as there are numbers
    lineage = union(lines).groupBy("table_name", F.col("bucket").cast("bigint").alias("bucket")).agg(F.sha2(F.array_join(starts, ","), 256).alias("lineage_sha256"))
    digests = ids_digests(counted.select("table_name", F.col("bucket").cast("string").alias("_b"), F.col("_id"), "n"), ["table_name", "_b"], "_id").select("table_name", F.col("_b").cast("bigint").alias("bucket"), "ids_sha256")
    out = files.join(joined, "bucket", "left").join(lineage, ["table_name", "bucket"]).join(digests, ["table_name", "bucket"])
    return out.select("table_name", plain_path(F.col("path")).alias("path"), "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).cast("bigint").alias("n_joined"), "rewritten")


def plain_path(path: Column) -> Column:
    """Paths of the local file system without its scheme; others whole."""
    return F.regexp_replace(path, "^file:/*", "/")


def co_bucket(heads: DataFrame, details: DataFrame, head_start: Column, detail_start: Column, starts: int, pair: Pair, names: tuple[str, str], folder: str) -> DataFrame:
    """Writes both tables in starting files below ``folder``, rewrites them by bucket there, and reports the files.

    head_start, detail_start: number (0 to ``starts`` - 1) of a row's starting file.
    """
    spark = heads.sparkSession
    tables = dict(zip(names, (heads, details), strict=True))
    if any(df.columns[0] != pair.key for df in tables.values()):
        raise ValueError(f"{pair.key} must be the first column of both tables")
    folders, work = {t: f"{folder}/{t}" for t in names}, f"{folder}/_work"
    for (t, df), number in zip(tables.items(), (head_start, detail_start), strict=True):
        write_start(df, number, starts, folders[t], f"{work}/{t}", pair.fanout)
    there = {t: spark.read.schema(StructType([*df.schema, StructField("layout", StringType())])).parquet(folders[t]) for t, df in tables.items() if _folders(spark, folders[t])}
    tally = {t: tallies(df, pair.key) for t, df in there.items()}
    orphans = None
    if details_name := names[1] if names[1] in there else None:
        keys = tally[details_name].where(F.col(pair.key).isNotNull()).select(pair.key).distinct()
        if names[0] in tally:
            keys = keys.join(tally[names[0]].select(pair.key), pair.key, "left_anti")
        orphans = cut(keys.withColumn("_orphan", F.lit(True)))
    moved, stay = {}, {}
    for t, df in there.items():
        missing = orphans if t == details_name else None
        moved[t] = moves(tally[t], missing, pair)
        stay[t] = staying(moved[t])
        rewrite(df, tables[t].columns, missing, stay[t], pair, folders[t], f"{work}/{t}")
    _delete(spark, work)
    return report(spark, folders, moved, stay, pair)


def op13_radix_co_bucketing(spark, sf_dir: str) -> DataFrame:
    """The final files of sales and sale_lines in a new folder of the shared one."""
    pair = Pair("sale_id")
    bucket = F.when(F.col("sale_id").isNull(), pair.orphan + 1).otherwise(F.crc32(F.concat(F.lit(pair.salt), F.col("sale_id").cast("string"))) % pair.buckets)
    head_start = F.when(bucket % 4 == 1, bucket - 1).otherwise(bucket)
    detail_start = F.coalesce(F.crc32(F.col("item_id").cast("string")) % pair.buckets, F.lit(0))
    folder = f"{shared_folder(spark).rstrip('/')}/co-bucketed-{uuid.uuid4().hex}"
    return co_bucket(read(spark, sf_dir, "sales"), read(spark, sf_dir, "sale_lines"), head_start, detail_start, pair.numbers, pair, ("sales", "sale_lines"), folder)
