"""Readers: line-oriented JSON, chunks, review tables, question lists, page blocks of PDF files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import UserError
from ..functions import text as T
from ..operators.gold import REVIEW_COLUMNS

CHUNK = "id string, tema string, tema_id string, pagina_inicio int, pagina_fim int, paragrafos int, n_tokens int, texto string"
GOLD = "id string, pergunta string, resposta_ref string, evidencia array<string>, tipo string, tema_id string, origem string, revisado boolean, split string"
RESPONSE = (
    "run_id string, config string, retriever string, leitor string, modelo string, q_id string, pergunta string, tipo string, recuperadas array<struct<id:string,score:double,rank:int>>, "
    "resposta string, absteve boolean, citou_fonte boolean, fonte_valida boolean, citacoes array<struct<tema_id:string,pagina:int>>, latencia_s double, t_embedding_s double, t_busca_s double, "
    "t_leitura_s double, n_tokens_prompt int, n_tokens_resposta int, repeticao int"
)


def require_file(path: str, suffixes: tuple[str, ...] = ()) -> Path:
    """A file on the driver; suffixes are compared without case."""
    p = Path(path)
    if not p.exists():
        raise UserError(f"{path} does not exist")
    if not p.is_file():
        raise UserError(f"{path} is not a file")
    if suffixes and p.suffix.lower() not in suffixes:
        raise UserError(f"{path}: expected {' or '.join(suffixes)}")
    return p


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One object a line by a fixed schema. Broken lines, lines that are no objects and rows without a required field
    are errors, found in one pass over the file and told with their line numbers; blank lines are skipped."""
    # a place in the scan; it is made a line number only if there is something to tell
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).where(T.strip(F.col("value")) != "")
    parsed = lines.select("value", "_file", "_at", F.from_json("value", _with_corrupt(spark, schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("o"), F.substring(T.strip(F.col("value")), 1, 1).alias("_c"))
    bad = F.col("o").isNull() | F.col("o._corrupt").isNotNull() | (F.col("_c") != "{")
    lacking = F.concat_ws(", ", *(F.when(F.col(f"o.{c}").isNull(), F.lit(c)) for c in required))
    wrong = parsed.select(F.when(bad, F.concat(F.lit("broken line: "), F.substring("value", 1, 80))).when(lacking != "", F.concat(F.lit("missing: "), lacking)).alias("e"), "_file", "_at").where("e is not null").limit(5).collect()
    if wrong:
        raise UserError("; ".join(f"{r._file.rsplit('/', 1)[-1]}, line {line_number(spark, path, r._file, r._at)}: {r.e}" for r in wrong))
    return parsed.select("o.*").drop("_corrupt")


def line_number(spark: SparkSession, path: str, file: str, at: int) -> int:
    """The number, from 1, of the line at a place of the scan, within its file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_block_start").alias("_begin"))
    own = lines.where(F.col("_file") == file)
    begin = own.where(F.col("_at") == at).first()["_begin"]
    return own.where((F.col("_begin") < begin) | ((F.col("_begin") == begin) & (F.col("_at") <= at))).count()


def _with_corrupt(spark: SparkSession, schema: str) -> StructType:
    return StructType.fromDDL(schema).add("_corrupt", "string")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as (id, section, section_id, page_start, page_end, n_paragraphs, n_tokens, text)."""
    raw = read_jsonl(spark, path, CHUNK, tuple(c.split()[0] for c in CHUNK.split(", ")))
    return raw.select("id", F.col("tema").alias("section"), F.col("tema_id").alias("section_id"), F.col("pagina_inicio").alias("page_start"), F.col("pagina_fim").alias("page_end"), F.col("paragrafos").alias("n_paragraphs"), "n_tokens", F.col("texto").alias("text"))


def delimiter(header: str) -> str:
    """Of semicolon, comma and tab the most frequent in the header; the first of them on a tie."""
    return max(";,\t", key=header.count)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review file with ``line`` (2 for the first row); columns that are missing are an error."""
    head = spark.read.text(path).limit(1).collect()
    header = head[0].value.lstrip("﻿") if head else ""
    sep = delimiter(header)
    names = [c.strip().strip('"') for c in header.split(sep)]
    missing = [c for c in REVIEW_COLUMNS if c not in names]
    if missing:
        raise UserError(f"{path}: missing columns {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    return rows.withColumn("line", F.monotonically_increasing_id() + 2)  # one file with breaks inside fields is one partition


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, text): the file's lines without blank ones and comments, numbered u001, u002, ..."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "line")).select("pos", T.strip(F.col("line")).alias("text"))
    found = [r.text for r in lines.where("text <> '' and not startswith(text, '#')").orderBy("pos").collect()]  # typed by hand
    if not found:
        raise UserError(f"{path}: no questions")
    return spark.createDataFrame([(f"u{n:03d}", t) for n, t in enumerate(found, 1)], "q_id string, text string")


def read_pdf_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, n_pages) of PDF files, one document a file, if the parser library is installed.

    Files are read by Spark, so they may lie in any store; each is parsed whole by one task.
    """
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        raise UserError("reading PDF files needs the pymupdf package; give blocks as a table instead") from None

    import pandas as pd

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for f in frames:
            rows = []
            for name, content in zip(f["path"], f["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    if doc.needs_pass:
                        raise UserError(f"{name} is protected by a password")
                    for number, page in enumerate(doc, 1):
                        rows.append((name, number, 0.0, 0.0, -1, 2, ""))
                        rows += [(name, number, b[0], b[1], b[5], b[6], b[4]) for b in page.get_text("blocks")]
            yield pd.DataFrame(rows, columns=["path", "page", "x0", "y0", "block_no", "kind", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "path string, page int, x0 double, y0 double, block_no int, kind int, text string").withColumn("doc_id", F.xxhash64("path"))
    return rows.where("kind <> 2"), rows.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
