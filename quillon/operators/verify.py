"""What an answer says against what was retrieved: abstention, citations, and whether a citation fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PHRASE = "Não encontrado no manual"


def source_valid(citations: Column, chunks: Column) -> Column:
    """Whether any citation fits any of an array of chunks (section_id, page_start, page_end)."""
    return F.exists(citations, lambda c: F.exists(chunks, lambda t: T.cites(c, t["section_id"], t["page_start"], t["page_end"])))


def verified(answers: DataFrame, phrase: str = PHRASE) -> DataFrame:
    """Adds abstained, citations, cited and source_valid to answers with ``answer`` and ``chunks``."""
    found = answers.withColumn("abstained", T.abstains(F.col("answer"), F.lit(phrase))).withColumn("citations", T.citations(F.col("answer")))
    valid = F.coalesce(source_valid(F.col("citations"), F.col("chunks")), F.lit(False))
    return found.withColumn("cited", F.size("citations") > 0).withColumn("source_valid", valid)


def below_threshold(best: Column, mode: Column, threshold: float | None) -> Column:
    """Whether a question goes unanswered without asking a model: no hit, or the best score under the threshold."""
    if threshold is None:
        return F.lit(False)
    return (mode != "none") & (best.isNull() | (F.round(best, 6) < threshold))


def extractive_answer(questions: DataFrame, ranked_chunks: DataFrame, phrase: str = PHRASE, least: int = 2) -> DataFrame:
    """(q_id, answer) by a reader without a model: the retrieved sentence that shares most words with the question.

    questions (q_id, text); ranked_chunks (q_id, rank, section_id, section, page_start, text). Words have three letters
    or digits at least; the first of the best sentences wins; below ``least`` shared words the answer is the phrase.
    """
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)))
    sentences = ranked_chunks.select("q_id", "rank", T.section_label(F.col("section_id"), F.col("section")).alias("label"), "page_start", F.posexplode(F.split("text", r"(?<=[.!?])(?U)\s+")).alias("pos", "sentence"))
    points = F.size(F.array_intersect(terms(F.col("sentence")), F.col("terms")))
    scored = sentences.join(questions.select("q_id", terms(F.col("text")).alias("terms")), "q_id").withColumn("points", points)
    best = scored.groupBy("q_id").agg(F.min(F.struct((-F.col("points")).alias("worse"), "rank", "pos", "sentence", "label", "page_start")).alias("b"))
    said = F.concat(F.regexp_replace("b.sentence", r"\.+$", ""), F.lit(" (seção "), F.col("b.label"), F.lit(", p. "), F.col("b.page_start").cast("string"), F.lit(")."))
    return questions.select("q_id").join(best, "q_id", "left").select("q_id", F.when(F.col("b.worse") <= -least, said).otherwise(F.lit(f"{phrase}.")).alias("answer"))
