"""Paragraphs to chunks within a token budget.

Paragraphs are never cut, and a chunk never spans two headings. Where chunks begin is found by scans over paragraphs
without their texts (see ``packing``), so a document and a heading may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written
from .packing import packed

BINS = 10


def chunks(paragraphs: DataFrame, max_tokens: int = 400, min_tokens: int = 60, per_word: float = 1.3, overlap: int = 0) -> DataFrame:
    """(doc_id, id, section, section_id, page_start, page_end, n_paragraphs, n_tokens, text) in document order.

    overlap: so many last paragraphs of the chunk before, in the same segment, come first. Paragraphs (doc_id, idx, page,
    section, section_id, text, is_title) have distinct idx within a document.
    """
    rows = written(paragraphs.select("doc_id", "idx", "page", "section", "section_id", "text", "is_title", F.size(T.words(F.col("text"))).alias("words")))
    placed, made = packed(rows.select("doc_id", "idx", "words", F.col("is_title").alias("title"), F.struct("section_id", "section").alias("key")), max_tokens, min_tokens, per_word)
    placed = placed.select(F.col("doc_id").alias("_doc"), F.col("idx").alias("_idx"), "chunk")
    numbered = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("idx") == F.col("_idx")))
    groups = numbered.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "page", "text", "section", "section_id", "words"))).alias("p"))
    if overlap:
        groups = written(groups)
        tails = groups.select(F.col("doc_id").alias("_doc"), (F.col("chunk") + 1).alias("_chunk"), F.slice("p", -F.least(F.lit(overlap), F.size("p")), F.least(F.lit(overlap), F.size("p"))).alias("tail"))
        following = made.where(~F.col("opens")).join(tails, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("chunk") == F.col("_chunk"))).select("_doc", "_chunk", "tail")
        groups = groups.join(following, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("chunk") == F.col("_chunk")), "left").withColumn("p", F.when(F.col("tail").isNotNull(), F.concat("tail", "p")).otherwise(F.col("p")))
    number = F.col("chunk").cast("string")
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return groups.withColumn("id", F.concat(F.lit("t"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))).select(
        "doc_id",
        "id",
        F.col("p")[0]["section"].alias("section"),
        F.col("p")[0]["section_id"].alias("section_id"),
        F.array_min(F.transform("p", lambda x: x["page"])).alias("page_start"),
        F.array_max(F.transform("p", lambda x: x["page"])).alias("page_end"),
        F.size("p").alias("n_paragraphs"),
        T.token_estimate(F.aggregate("p", F.lit(0), lambda n, x: n + x["words"]), per_word).alias("n_tokens"),  # lines end words, so a chunk has those of its paragraphs
        text.alias("text"),
    )


def statistics(chunks: DataFrame, max_tokens: int = 400, min_tokens: int = 60) -> DataFrame:
    """One row: counts, and mean, median, least and most tokens."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct(F.when(F.col("section_id") == "", "unnumbered").otherwise(F.col("section_id"))).alias("n_sections"),
        F.round(F.avg("n_tokens"), 1).alias("mean_tokens"),
        F.percentile("n_tokens", F.lit(0.5)).alias("median_tokens"),
        F.min("n_tokens").alias("min_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.count_if(F.col("n_tokens") > max_tokens).alias("above_max"),
        F.count_if(F.col("n_tokens") < min_tokens).alias("below_min"),
    )


def section_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.when(F.col("section_id") == "", "unnumbered").otherwise(F.col("section_id")).alias("section_id")).agg(F.count("*").alias("n"))


def histogram(chunks: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin_lo, bin_hi, n): tokens in bins of one width, empty bins too; the last bin takes what is left."""
    width = chunks.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.max("n_tokens"), F.lit(0)) / F.lit(bins))).cast("bigint").alias("w"))
    frame = chunks.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(width))
    counted = chunks.select("n_tokens").join(F.broadcast(width)).groupBy(F.least(F.floor(F.col("n_tokens") / F.col("w")), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return frame.join(counted, "bin", "left").select((F.col("bin") * F.col("w")).alias("bin_lo"), ((F.col("bin") + 1) * F.col("w") - 1).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"))
