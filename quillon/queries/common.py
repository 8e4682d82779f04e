"""Reading tables, and fragments of SQL that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables of long texts.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table. Texts that lie in fewer pieces than there are cores are dealt out; others are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < min(cores, 16) else df


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1)"


def estimate(n: str) -> str:
    return f"greatest(1, round_even({n} * 1.3::DOUBLE, 0)::INT)"
