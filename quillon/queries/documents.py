"""Cleaning, titles, sections and chunks. A document's lines stand for blocks, its source for a section or a manual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, ingest
from .common import estimate, strip, table, tokens, words

SHARE = 0.03


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def tokenize_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def token_estimates(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("bigint").alias("n_words"), T.token_estimate(n).alias("n_tokens"))


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"), F.length(T.clean(F.col("text"))).cast("bigint").alias("n_chars"))


def clean_pages(spark, sf_dir):
    plain = F.regexp_replace("html", "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean(plain)).alias("cleaned"))


def _cleaned(x: str) -> str:
    for a, b in T.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\x{{a0}}\\t]', ' ', 'g')"
    x = f"regexp_replace({x}, '\\x{{ad}}\\n?', '', 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])-[ ]*\\n[ ]*([a-zà-öø-ÿ])', '\\1\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])/[ ]*\\n[ ]*([\\p{{L}}\\p{{N}}_])', '\\1/\\2', 'g')"
    part = strip("regexp_replace(regexp_replace(p, '[ ]*\\n[ ]*', ' ', 'g'), ' {2,}', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '\\n[ ]*\\n'), lambda p: {part}), lambda q: q <> ''), chr(10) || chr(10))"


def _pages(spark, sf_dir):
    """All documents as the pages of one manual, their lines as blocks."""
    docs = table(spark, sf_dir, "documents")
    blocks = lines(spark, sf_dir).select(F.lit(0).alias("doc_id"), F.col("doc_id").alias("page"), F.col("pos").alias("block_idx"), "text").where(T.strip(F.col("text")) != "")
    return blocks, docs.agg(F.count("*").alias("n_pages")).withColumn("doc_id", F.lit(0))


def boilerplate_lines(spark, sf_dir):
    blocks, n = _pages(spark, sf_dir)
    return ingest.repeated_keys(blocks, n, SHARE).select("key")


def boilerplate_removed(spark, sf_dir):
    blocks, n = _pages(spark, sf_dir)
    kept = ingest.without_repeated(blocks, ingest.repeated_keys(blocks, n, SHARE))
    return kept.groupBy("page").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars")).withColumnRenamed("page", "doc_id")


_KEY = strip("regexp_replace(regexp_replace(text, '\\p{Nd}', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')")
_KEYS = f"""l AS ({LINES}), b AS (SELECT doc_id, text, {_KEY} AS key FROM l WHERE {strip("text")} <> ''),
  k AS (SELECT key FROM b GROUP BY key HAVING count(DISTINCT doc_id) > {SHARE} * (SELECT count(*) FROM documents) AND count(DISTINCT doc_id) >= 2)"""


def text_layer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    blocks = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return ingest.text_layer(blocks, docs.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_pages")))


def block_order(spark, sf_dir):
    blocks = lines(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), (F.length("text") % 40 * 0.25).alias("y0"), (F.col("pos") % 7).cast("double").alias("x0"), F.col("pos").alias("block_no"), (F.col("pos") % 5 == 4).cast("int").alias("kind"), "text")
    return ingest.text_blocks(blocks).select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("block_idx").cast("bigint").alias("block_idx"))


_NUMBER = "concat_ws('.', (1 + doc_id // 40 % 9)::VARCHAR, CASE WHEN doc_id % 3 > 0 THEN (1 + doc_id % 7)::VARCHAR END)"


def title_detect(spark, sf_dir):
    """The first line of each document, numbered, as a candidate."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", _title_number(), F.split("text", "\n")[0]).alias("line"))
    return t.select("doc_id", F.coalesce(T.title_number(F.col("line")), F.lit("")).alias("section_id"), T.is_contents_line(F.col("line")).alias("contents"))


def _title_number() -> Column:
    return F.concat_ws(".", (1 + F.floor(F.col("doc_id") / 40) % 9).cast("string"), F.when(F.col("doc_id") % 3 > 0, (1 + F.col("doc_id") % 7).cast("string")))


def _titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("at"), _title_number().alias("section_id"))


def title_sequence(spark, sf_dir):
    """Which numbered titles follow those accepted before, source by source."""
    return ingest.accepted_titles(_titles(spark, sf_dir), ["at"]).select(F.col("doc_id").alias("source"), F.col("at").alias("doc_id"), "section_id", "accepted")


def section_ffill(spark, sf_dir):
    """The section that each document of a source lies in: that of the last accepted title."""
    t = ingest.accepted_titles(_titles(spark, sf_dir), ["at"])
    return t.select(F.col("doc_id").alias("source"), F.col("at").alias("doc_id"), F.col("current").alias("section_id"))


_SEQUENCE = f"""RECURSIVE t AS (SELECT source, doc_id, {_NUMBER} AS section_id, list_transform(string_split({_NUMBER}, '.'), lambda x: x::INT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
  f AS (SELECT source, doc_id, section_id, i, true AS accepted, section_id AS now, n AS c FROM t WHERE i = 1
    UNION ALL SELECT source, doc_id, section_id, i, ok, CASE WHEN ok THEN section_id ELSE now END, CASE WHEN ok THEN n ELSE c END
    FROM (SELECT t.source, t.doc_id, t.section_id, t.i, t.n, f.now, f.c, CASE
      WHEN t.n[1] <> f.c[1] THEN t.n[1] - f.c[1] BETWEEN 1 AND 5 AND coalesce(t.n[2] BETWEEN 1 AND 5, true)
      WHEN len(t.n) = 1 THEN false
      WHEN len(f.c) = 1 THEN t.n[2] BETWEEN 1 AND 5
      ELSE t.n[2] - f.c[2] BETWEEN 1 AND 5 END AS ok FROM f JOIN t ON t.source = f.source AND t.i = f.i + 1))"""


def _paragraphs(spark, sf_dir):
    """Each line a paragraph; ten a page; a line whose place is a multiple of 23 is a title."""
    t = lines(spark, sf_dir).where(T.strip(F.col("text")) != "")
    return t.select("doc_id", F.col("pos").alias("idx"), (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), F.col("source").alias("section"), F.floor(F.col("pos") / 23).cast("string").alias("section_id"), "text", (F.col("pos") % 23 == 22).alias("is_title"))


def chunk_greedy(spark, sf_dir):
    made = chunking.chunks(_paragraphs(spark, sf_dir), max_tokens=60, min_tokens=20)
    return made.select("doc_id", "id", "section_id", "page_start", "page_end", F.col("n_paragraphs").cast("bigint").alias("n_paragraphs"), "n_tokens", F.md5("text").alias("text_md5"))


_CHUNKS = f"""RECURSIVE l AS ({LINES}), p AS (SELECT doc_id, pos AS idx, pos // 10 + 1 AS page, source AS section, (pos // 23)::VARCHAR AS section_id, text, pos % 23 = 22 AS is_title, len({words("text")}) AS w FROM l WHERE {strip("text")} <> ''),
  b AS (SELECT *, CASE WHEN is_title OR lag(section_id) OVER d IS DISTINCT FROM section_id THEN 1 ELSE 0 END AS begins FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY idx)),
  s AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY idx) AS seg FROM b),
  q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY idx) AS i FROM s WHERE NOT is_title),
  g1 AS (SELECT doc_id, seg, i, w, w AS held, 1 AS g FROM q WHERE i = 1
    UNION ALL SELECT q.doc_id, q.seg, q.i, q.w, CASE WHEN {estimate("(g1.held + q.w)")} > 60 THEN q.w ELSE g1.held + q.w END, CASE WHEN {estimate("(g1.held + q.w)")} > 60 THEN g1.g + 1 ELSE g1.g END
    FROM g1 JOIN q ON q.doc_id = g1.doc_id AND q.seg = g1.seg AND q.i = g1.i + 1),
  s1 AS (SELECT doc_id, seg, g, sum(w) AS w FROM g1 GROUP BY ALL),
  g2 AS (SELECT doc_id, seg, g, w, w AS held, 1 AS h FROM s1 WHERE g = 1
    UNION ALL SELECT s1.doc_id, s1.seg, s1.g, s1.w, CASE WHEN {estimate("g2.held")} >= 20 THEN s1.w ELSE g2.held + s1.w END, CASE WHEN {estimate("g2.held")} >= 20 THEN g2.h + 1 ELSE g2.h END
    FROM g2 JOIN s1 ON s1.doc_id = g2.doc_id AND s1.seg = g2.seg AND s1.g = g2.g + 1),
  c AS (SELECT q.doc_id, q.seg, h, min(section_id) AS section_id, min(page)::INT AS page_start, max(page)::INT AS page_end, count(*) AS n_paragraphs, {estimate("sum(q.w)")} AS n_tokens, md5(string_agg(text, chr(10) ORDER BY idx)) AS text_md5
    FROM q JOIN g1 USING (doc_id, seg, i) JOIN g2 ON g2.doc_id = q.doc_id AND g2.seg = q.seg AND g2.g = g1.g GROUP BY ALL)"""


def _as_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("section_id"), T.token_estimate(F.size(T.words(F.col("text")))).alias("n_tokens"))


def chunk_stats(spark, sf_dir):
    s = chunking.statistics(_as_chunks(spark, sf_dir))
    return s.select("n_chunks", "n_sections", "mean_tokens", F.col("median_tokens").cast("double").alias("median_tokens"), "min_tokens", "max_tokens", "above_max", "below_min")


def section_counts(spark, sf_dir):
    return chunking.section_counts(_as_chunks(spark, sf_dir))


def token_histogram(spark, sf_dir):
    return chunking.histogram(_as_chunks(spark, sf_dir))


_AS_CHUNKS = f"SELECT source AS section_id, {estimate(f'len({words("text")})')} AS n_tokens FROM documents"


def hash_embedding(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(V.embedding_tokens(F.col("text"))).alias("w"))
    return found.groupBy("doc_id", V.bucket(F.col("w"), 1024).alias("bucket")).agg(F.count("*").alias("n"))


def unit_vectors(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalised(V.checked_dimension(F.col("embedding"), 64)).alias("v"))
    return t.select("vec_id", F.round(V.inner_product(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 5).alias("first"))


QUERIES = {f.__name__: f for f in (tokenize_counts, token_estimates, clean_text, clean_pages, boilerplate_lines, boilerplate_removed, text_layer, block_order, title_detect, title_sequence, section_ffill, chunk_greedy, chunk_stats, section_counts, token_histogram, hash_embedding, unit_vectors)}

ORACLES = {
    "tokenize_counts": f"SELECT doc_id, len({tokens('text')})::BIGINT AS n_tokens, len(list_distinct({tokens('text')}))::BIGINT AS n_distinct FROM documents",
    "token_estimates": f"SELECT doc_id, len({words('text')})::BIGINT AS n_words, {estimate(f'len({words("text")})')} AS n_tokens FROM documents",
    "clean_text": f"SELECT doc_id, md5({_cleaned('text')}) AS cleaned, length({_cleaned('text')})::BIGINT AS n_chars FROM documents",
    "clean_pages": f"SELECT page_id, md5({_cleaned("regexp_replace(html, '<[^>]*>', chr(10), 'g')")}) AS cleaned FROM pages",
    "boilerplate_lines": f"WITH {_KEYS} SELECT key FROM k",
    "boilerplate_removed": f"WITH {_KEYS} SELECT doc_id, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM b WHERE key NOT IN (SELECT key FROM k) GROUP BY doc_id",
    "text_layer": f"""SELECT source AS doc_id, count(*) AS n_pages, count(*) FILTER (length({strip("text")}) < 50) AS empty_pages, count(*) FILTER (length({strip("text")}) < 50) <= 0.8 * count(*) AS readable FROM documents GROUP BY source""",
    "block_order": f"""WITH l AS ({LINES}) SELECT doc_id, pos::BIGINT AS block_no, (row_number() OVER (PARTITION BY doc_id ORDER BY round_even(length(text) % 40 * 0.25::DOUBLE, 1), pos % 7, pos) - 1)::BIGINT AS block_idx
      FROM l WHERE pos % 5 <> 4 AND {strip("text")} <> ''""",
    "title_detect": f"""WITH t AS (SELECT doc_id, concat_ws(' ', {_NUMBER}, string_split(text, chr(10))[1]) AS line FROM documents)
      SELECT doc_id, regexp_extract({strip("line")}, '^(\\d+(\\.\\d+){{0,3}})\\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ][^\\n]{{2,80}}$', 1) AS section_id, regexp_matches(line, '(\\.\\s?){{4,}}\\s*\\d+\\s*$|…+\\s*\\d+\\s*$') AS contents FROM t""",
    "title_sequence": f"WITH {_SEQUENCE} SELECT source, doc_id, section_id, accepted FROM f",
    "section_ffill": f"WITH {_SEQUENCE} SELECT source, doc_id, now AS section_id FROM f",
    "chunk_greedy": f"WITH {_CHUNKS} SELECT doc_id, concat('t', lpad((row_number() OVER (PARTITION BY doc_id ORDER BY seg, h))::VARCHAR, 4, '0')) AS id, section_id, page_start, page_end, n_paragraphs, n_tokens, text_md5 FROM c",
    "chunk_stats": f"""WITH c AS ({_AS_CHUNKS}) SELECT count(*) AS n_chunks, count(DISTINCT section_id) AS n_sections, round(avg(n_tokens), 1) AS mean_tokens, median(n_tokens)::DOUBLE AS median_tokens, min(n_tokens) AS min_tokens, max(n_tokens) AS max_tokens,
      count(*) FILTER (n_tokens > 400) AS above_max, count(*) FILTER (n_tokens < 60) AS below_min FROM c""",
    "section_counts": f"WITH c AS ({_AS_CHUNKS}) SELECT section_id, count(*) AS n FROM c GROUP BY section_id",
    "token_histogram": f"""WITH c AS ({_AS_CHUNKS}), w AS (SELECT greatest(1, ceil(max(n_tokens) / 10.0))::BIGINT AS w FROM c), n AS (SELECT least(n_tokens // w, 9) AS bin, count(*) AS n FROM c, w GROUP BY 1)
      SELECT (b.bin * w)::BIGINT AS bin_lo, ((b.bin + 1) * w - 1)::BIGINT AS bin_hi, coalesce(n.n, 0)::BIGINT AS n FROM (SELECT unnest(range(10)) AS bin) b, w LEFT JOIN n ON n.bin = b.bin""",
    "hash_embedding": f"""WITH t AS (SELECT doc_id, unnest(CASE WHEN len({tokens("text")}) > 0 THEN {tokens("text")} ELSE [text] END) AS w FROM documents)
      SELECT doc_id, (('0x' || right(md5(w), 3))::INT % 1024)::INT AS bucket, count(*) AS n FROM t GROUP BY ALL""",
    "unit_vectors": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS l FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)) / (l * l), 6) AS length, round(e[1] / l, 5) AS first FROM n",
}
