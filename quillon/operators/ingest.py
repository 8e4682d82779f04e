"""Page blocks to paragraphs that know their page and section.

Order is kept in columns: blocks by (doc_id, page, block_idx), paragraphs by (doc_id, idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UserError
from ..functions import text as T
from .titles import accepted_titles

# A page with less text counts as empty; above this share of empty pages a document needs OCR.
MIN_PAGE_CHARS, MAX_EMPTY_SHARE = 50, 0.8
#: The section before any title.
NO_SECTION = "Sem título"


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of text that aren't blank, with block_idx in reading order: down the page, then across."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.bround("y0", 1), "x0", "block_no")
    return blocks.where((F.col("kind") == 0) & (T.strip(F.col("text")) != "")).withColumn("text", T.composed(F.col("text"))).withColumn("block_idx", F.row_number().over(order) - 1)


def text_layer(blocks: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, empty_pages, readable) from blocks and (doc_id, n_pages)."""
    chars = blocks.groupBy("doc_id", "page").agg(F.sum(F.length(T.strip(F.col("text")))).alias("chars"))
    full = chars.where(F.col("chars") >= MIN_PAGE_CHARS).groupBy("doc_id").agg(F.count("*").alias("full"))
    empty = F.col("n_pages") - F.coalesce("full", F.lit(0))
    return n_pages.join(full, "doc_id", "left").select("doc_id", "n_pages", empty.alias("empty_pages"), ((F.col("n_pages") > 0) & (empty <= MAX_EMPTY_SHARE * F.col("n_pages"))).alias("readable"))


def repeated_keys(blocks: DataFrame, n_pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, key) of blocks that occur on over ``share`` of a document's pages, and on two at least."""
    pages = blocks.groupBy("doc_id", T.repetition_key(F.col("text")).alias("key")).agg(F.countDistinct("page").alias("pages"))
    return pages.join(n_pages, "doc_id").where((F.col("pages") > F.lit(share) * F.col("n_pages")) & (F.col("pages") >= 2)).select("doc_id", "key")


def without_repeated(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    return blocks.withColumn("key", T.repetition_key(F.col("text"))).join(keys, ["doc_id", "key"], "left_anti").drop("key")


def parts(blocks: DataFrame, title: str = T.TITLE) -> DataFrame:
    """Each block cut at blank lines: number and title of its first line if that is one, the rest, and all lines.

    Lines of a table of contents are dropped. Two lines that make one title together are a title.
    """
    lines = F.filter(F.transform(F.split("raw", r"\n"), T.strip), lambda x: (x != "") & ~T.is_contents_line(x))
    cut = blocks.select("doc_id", "page", "block_idx", F.posexplode(F.split("text", r"\n(?U)\s*\n")).alias("part_idx", "raw")).withColumn("lines", lines).where(F.size("lines") > 0)
    both = T.strip(T.clean(F.array_join("lines", "\n")))
    first = T.strip(T.clean(F.col("lines")[0]))
    out = cut.withColumn("first", first).withColumn("both", F.when(F.size("lines") == 2, both))
    return out.select(
        "doc_id",
        "page",
        "block_idx",
        "part_idx",
        "lines",
        T.title_number(F.col("first"), title).alias("own"),
        T.title_number(F.col("both"), title).alias("joined"),
        "first",
        "both",
    ).select(
        "doc_id",
        "page",
        "block_idx",
        "part_idx",
        "lines",
        F.when(F.col("own").isNotNull(), F.coalesce("joined", "own")).alias("section_id"),
        F.when(F.col("own").isNotNull(), F.when(F.col("joined").isNotNull(), F.col("both")).otherwise(F.col("first"))).alias("section"),
        F.when(F.col("own").isNull(), F.col("lines")).when(F.col("joined").isNotNull(), F.array().cast("array<string>")).otherwise(F.slice("lines", F.lit(2), F.size("lines"))).alias("rest"),
    )


def paragraphs(blocks: DataFrame, n_pages: DataFrame, share: float = 0.5, title: str = T.TITLE, min_chars: int = 25, check_order: bool = True, drop_repeated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, idx, page, section, section_id, text, is_title) and counts by document, from blocks with block_idx."""
    kept = without_repeated(blocks, repeated_keys(blocks, n_pages, share)) if drop_repeated else blocks
    order = ["page", "block_idx", "part_idx"]
    cut = parts(kept, title)
    if check_order:
        judged = accepted_titles(cut.where("section_id is not null"), order).select("doc_id", *order, "accepted")
        cut = cut.join(judged, ["doc_id", *order], "left")
    else:
        cut = cut.withColumn("accepted", F.col("section_id").isNotNull())
    is_title = F.coalesce("accepted", F.lit(False))
    body = T.clean(F.array_join(F.when(is_title, F.col("rest")).otherwise(F.col("lines")), "\n"))
    none = F.lit(None).cast("string")
    texts = F.transform(F.split(body, "\n\n"), lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_title"), none.alias("id"), none.alias("name")))
    head = F.array(F.struct(F.col("section").alias("text"), F.lit(True).alias("is_title"), F.col("section_id").alias("id"), F.col("section").alias("name")))
    rows = cut.select("doc_id", *order, "section_id", is_title.alias("accepted"), F.posexplode(F.when(is_title, F.concat(head, texts)).otherwise(texts)).alias("sub", "x"))
    rows = rows.select("doc_id", *order, "sub", "x.*", F.col("section_id").isNotNull().alias("candidate"), "accepted")
    long = F.col("is_title") | (F.length("text") >= min_chars)
    counts = rows.groupBy("doc_id").agg(
        F.sum(F.col("is_title").cast("int")).alias("n_titles"),
        F.sum((~F.col("is_title") & long).cast("int")).alias("n_paragraphs"),
        F.sum((~long & (F.col("text") != "")).cast("int")).alias("short_dropped"),
        F.sum((F.col("candidate") & ~F.col("accepted") & (F.col("sub") == 0)).cast("int")).alias("titles_out_of_order"),
    )
    by = Window.partitionBy("doc_id").orderBy(*order, "sub")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.where(long).select(
        "doc_id",
        (F.row_number().over(by) - 1).alias("idx"),
        "page",
        F.coalesce(F.last("name", ignorenulls=True).over(so_far), F.lit(NO_SECTION)).alias("section"),
        F.coalesce(F.last("id", ignorenulls=True).over(so_far), F.lit("")).alias("section_id"),
        "text",
        "is_title",
    )
    return out, counts


def require_readable(layer: DataFrame) -> None:
    """Raises if a document has no text layer; names ten at most."""
    bad = [r.doc_id for r in layer.where("not readable").orderBy("doc_id").limit(10).collect()]
    if bad:
        raise UserError(f"no text layer, run OCR first: {bad}")
