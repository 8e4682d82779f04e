"""Responses that arrive as files: each key is stored once, and running figures follow.

The batch engine resumes by an anti-join with what is stored; these are the same rules for a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["config", "leitor", "q_id", "repeticao"]


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def store_once(stream: DataFrame, folder: str, checkpoint: str, key: list[str] | None = None) -> StreamingQuery:
    """Appends each batch's new keys to a Parquet table. A batch that runs again writes its own part anew."""
    key = key or KEY

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            stored = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") != number)
            new = new.join(stored.select(*key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latency(stream: DataFrame, time_col: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Count, mean and greatest latency by window and config; rows later than ``delay`` are left out."""
    seen = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), "config")
    return seen.agg(F.count("*").alias("n"), F.avg("latencia_s").alias("mean_s"), F.max("latencia_s").alias("max_s")).select(F.col("w.start").alias("start"), "config", "n", "mean_s", "max_s")
