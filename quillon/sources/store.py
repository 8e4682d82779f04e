"""Folders of tables, wherever Spark's files are: a shared disk or a remote store."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import UserError


def _opened(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _opened(spark, path)
    return bool(fs.exists(p))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    fs, p = _opened(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _opened(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, 0 if it isn't there."""
    fs, p = _opened(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def scratch(spark: SparkSession) -> str:
    """A new folder for files between steps, in spark.checkpoint.dir; without that, and in one process only, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise UserError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written to a new folder there (or to a path) and read again."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
