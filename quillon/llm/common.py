"""What the operators of this subpackage share: reading tables, cutting lineage, and Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow's largest 32-bit list or string buffer, in bytes, is far above this; batches are cut to stay well below.
BATCH_BYTES = 16 << 20
#: Rows of an Arrow batch. Spark's own 10,000 whole texts would be held several times over, in the JVM and in Python.
BATCH_ROWS, SPARK_ROWS = 1000, "10000"
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, whole, through Spark's own reader (the folder may be in a store that only Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (as in tests) it is a folder below the system's temporary
    one; on a cluster a missing setting is an error, as files in a machine's own folder would be lost to the others.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "quillon-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later plans start from the files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of one key, at least, that ``join_classes`` spreads; parts over which it spreads them.
MANY, PARTS = 1000, 64


def join_classes(rows: DataFrame, classes: DataFrame, key: str, how: str = "left", many: int = MANY) -> DataFrame:
    """``rows`` joined with ``classes`` (one row for each key), where one key may hold any share of the rows.

    Keys of more than ``many`` rows, and of more than a thousandth of all, are found first: they are fewer than 1000,
    so they can be broadcast. Their rows are spread over PARTS, to each of which the class goes too. ``rows`` is read
    several times and numbered, so it must be a table or a checkpoint.
    """
    least = max(many, rows.count() // 1000)
    crowded = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key).collect()
    if not crowded:
        return rows.join(classes, key, how)
    marks = F.broadcast(rows.sparkSession.createDataFrame(crowded, rows.select(key).schema).withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marks, key, "left").withColumn("_part", part).drop("_hot")
    right = classes.join(marks, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_part"], how).drop("_part")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes at most (a single longer row stays whole)."""
    for batch in batches:
        parts = max(1, -(-batch.nbytes // most))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    """``run`` over the Arrow batches of each partition, which have BATCH_ROWS rows unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(ROWS_SETTING) == SPARK_ROWS:
        conf.set(ROWS_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, spark_ddl(schema))


def map_rows(df: DataFrame, schema: pa.Schema, make: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """``make`` over each Arrow batch of ``df``; it returns the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = make(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return arrow_map(df, run, schema)


def spark_ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_ddl(f.type)}" for f in schema)


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"{x.name}: {_ddl(x.type)}" for x in t) + ">"
    return {"int64": "bigint", "int32": "int", "double": "double", "float": "float", "string": "string", "bool": "boolean", "binary": "binary"}[str(t)]


def id_text(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
