"""Operators put together as jobs use them: composed texts, all retrieval modes, scored answers, stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, gold, metrics, verify
from ..operators import retrieval as R
from ..sources import readers, writers
from ..sources.store import scratch
from . import answers, documents, search, sets
from .common import estimate, table, tokens

# Letters of the sample, and the same in decomposed form.
DECOMPOSED = {"é": "é", "è": "è", "ê": "ê", "ü": "ü", "ö": "ö", "ä": "ä", "ñ": "ñ", "ó": "ó", "í": "í", "ç": "ç"}
#: Best scores below this leave a question unanswered.
LEAST_SCORE = 40.0


def composed_tokens(spark, sf_dir):
    """Every third text is taken apart into letters and marks; tokens and answers must not show it."""
    taken = F.col("text")
    for a, b in DECOMPOSED.items():
        taken = F.replace(taken, F.lit(a), F.lit(b))
    t = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, taken).otherwise(F.col("text")).alias("other"))
    cleaned = F.when(F.col("other") == F.col("text"), True).otherwise(T.clean(F.col("other"), compose=True) == T.clean(F.col("text"), compose=True))
    return t.select("doc_id", F.md5(F.array_join(T.tokens(F.col("other")), " ")).alias("tokens_md5"), metrics.exact_match(F.col("other"), F.col("text")).alias("em"), cleaned.alias("cleaned_alike"))


def _dense(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Vectors under the ids of documents; a question has the vector of its number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = search._questions(spark, sf_dir).select("q_id").join(vectors.withColumnRenamed("id", "q_id"), "q_id")
    return asked, vectors


def hybrid_retrieval(spark, sf_dir):
    """BM25 and vectors, twenty each, fused to five."""
    index, questions = search._index(spark, sf_dir)
    return R.retrieve("hybrid", questions, index, _dense(spark, sf_dir), k=5, depth=20, stop_words=search.STOP_WORDS).select("q_id", "id", "score", "rank")


def retrieval_modes(spark, sf_dir):
    """Three hits of each mode that has any: lexical and dense; none has none."""
    index, questions = search._index(spark, sf_dir)
    found = None
    for mode in ("none", "lexical", "dense"):
        options = {"stop_words": search.STOP_WORDS} if mode == "lexical" else {}
        hits = R.retrieve(mode, questions, index, _dense(spark, sf_dir), k=3, **options).select(F.lit(mode).alias("mode"), "q_id", F.col("id").cast("bigint").alias("id"), "rank")
        found = hits if found is None else found.unionByName(hits)
    return found


def threshold_abstention(spark, sf_dir):
    """Which questions go unanswered because their best hit scores too low."""
    index, questions = search._index(spark, sf_dir)
    best = index.search(questions, 1, stop_words=search.STOP_WORDS).select("q_id", "score")
    return questions.join(best, "q_id", "left").select("q_id", verify.below_threshold(F.col("score"), F.lit("lexical"), LEAST_SCORE).alias("abstains"))


def scored_answers(spark, sf_dir):
    """Replies that quote, add to, miss or refuse the reference, with and without retrieval, joined with their items."""
    i = F.col("item_id")
    own = F.concat(F.lit("t"), i.cast("string"))
    items = table(spark, sf_dir, "benchmark").select(own.alias("id"), F.when(i % 6 == 5, gold.UNANSWERABLE).otherwise("factual").alias("tipo"), F.col("text").alias("resposta_ref"), F.array(own).alias("evidencia"))
    said = F.when(i % 4 == 0, F.concat("text", F.lit(" (seção 1.1, p. 1)."))).when(i % 4 == 1, F.concat("text", F.lit(" zzqx"))).when(i % 4 == 2, F.lit("Não encontrado no manual.")).otherwise("zzqx")
    ids = F.when(i % 3 == 0, F.array(F.lit("x"), own)).when(i % 3 == 1, F.array(own)).otherwise(F.array(F.lit("x")))
    hits = F.transform(ids, lambda x, k: F.struct(x.alias("id"), F.lit(1.0).alias("score"), (k + 1).alias("rank")))
    replies = table(spark, sf_dir, "benchmark").select(
        own.alias("q_id"),
        F.lit("S").alias("config"),
        F.lit("base").alias("leitor"),
        F.lit(None).cast("int").alias("repeticao"),
        F.when(i % 5 == 0, "nenhum").otherwise("bm25").alias("retriever"),
        hits.alias("recuperadas"),
        said.alias("resposta"),
        (i % 4 == 2).alias("absteve"),
        (i % 4 == 0).alias("fonte_valida"),
        F.lit(1.0).alias("latencia_s"),
    )
    t = metrics.scored(replies, items)
    return t.select("q_id", "repeticao", "answerable", "em", F.round("f1_tokens", 6).alias("f1"), "bertscore_f1", "recall", F.round("mrr", 6).alias("mrr"))


def chunk_overlap(spark, sf_dir):
    """Chunks that begin with the last paragraph of the one before under the same heading."""
    made = chunking.chunks(documents._paragraphs(spark, sf_dir), max_tokens=60, min_tokens=20, overlap=1)
    return made.select("doc_id", "id", F.col("n_paragraphs").cast("bigint").alias("n_paragraphs"), "n_tokens", F.md5("text").alias("text_md5"))


def held_out_text(spark, sf_dir):
    """The text that perplexity is measured on, of sections without a test item."""
    test = gold.split(sets._items(spark, sf_dir), 0.3, 42).where("split = 'test'")
    kept = gold.held_out_chunks(sets._chunks(spark, sf_dir), test, 30, 42)
    return gold.held_out_text(kept).select(F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def stored_items(spark, sf_dir):
    """A question set written as lines of JSON and read back by its schema."""
    i = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), i.cast("string")).alias("id"),
        F.concat(F.lit('"quoted"\n\t'), F.col("text")).alias("pergunta"),
        F.when(i % 3 > 0, F.col("text")).otherwise("").alias("resposta_ref"),
        F.when(i % 2 == 0, F.array(F.lit("t1"), F.lit("t|2"))).otherwise(F.array().cast("array<string>")).alias("evidencia"),
        F.lit("factual").alias("tipo"),
        F.when(i % 5 > 0, F.lit("4.2")).alias("tema_id"),
    )
    path = scratch(spark)
    writers.write_jsonl(items, path)
    back = readers.read_jsonl(spark, path, readers.GOLD, ("id", "pergunta", "resposta_ref", "evidencia", "tipo"))
    return back.select("id", F.md5("pergunta").alias("pergunta_md5"), F.md5("resposta_ref").alias("resposta_md5"), F.array_join("evidencia", ",").alias("evidencia"), F.coalesce("tema_id", F.lit("-")).alias("tema_id"), F.col("revisado").isNull().alias("not_reviewed"))


QUERIES = {f.__name__: f for f in (composed_tokens, hybrid_retrieval, retrieval_modes, threshold_abstention, scored_answers, chunk_overlap, held_out_text, stored_items)}

_VECTORS = """nv AS (SELECT b.item_id AS q_id, e.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
  nr AS (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM nv)"""
_BEST = "row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)"

ORACLES = {
    "composed_tokens": f"SELECT doc_id, md5(array_to_string({tokens('nfc_normalize(text)')}, ' ')) AS tokens_md5, 1 AS em, true AS cleaned_alike FROM documents",
    "hybrid_retrieval": f"""WITH {search._BM25}, {search._ranked("r", 20)}, {_VECTORS}, f AS (SELECT q_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT q_id, id, rank FROM r UNION ALL SELECT q_id, id, rank FROM nr WHERE rank <= 20) GROUP BY ALL)
      SELECT q_id, id, score, {_BEST}::INT AS rank FROM f QUALIFY {_BEST} <= 5""",
    "retrieval_modes": f"""WITH {search._BM25}, {search._ranked("r", 3)}, {_VECTORS} SELECT 'lexical' AS mode, q_id, id, rank FROM r UNION ALL SELECT 'dense', q_id, id, rank FROM nr WHERE rank <= 3""",
    "threshold_abstention": f"WITH {search._BM25}, {search._ranked('r', 1)} SELECT item_id AS q_id, coalesce(score < {LEAST_SCORE}, true) AS abstains FROM benchmark LEFT JOIN r ON r.q_id = item_id",
    "scored_answers": f"""WITH t AS (SELECT item_id AS i, len({answers._normal("text")}) AS n FROM benchmark)
      SELECT concat('t', i) AS q_id, 1 AS repeticao, i % 6 <> 5 AS answerable, CASE WHEN i % 6 = 5 THEN NULL ELSE (i % 4 = 0)::INT END AS em,
        CASE WHEN i % 6 = 5 THEN NULL WHEN i % 4 = 0 THEN 1.0::DOUBLE WHEN i % 4 = 1 THEN round(2.0::DOUBLE * n / (2 * n + 1), 6) ELSE 0.0::DOUBLE END AS f1,
        CASE WHEN i % 6 <> 5 AND i % 4 = 2 THEN 0.0::DOUBLE END AS bertscore_f1,
        CASE WHEN i % 6 = 5 OR i % 5 = 0 THEN NULL ELSE (i % 3 < 2)::INT END AS recall,
        CASE WHEN i % 6 = 5 OR i % 5 = 0 THEN NULL WHEN i % 3 = 0 THEN 0.5::DOUBLE WHEN i % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mrr FROM t""",
    "chunk_overlap": f"""WITH {documents._CHUNKS},
      m AS (SELECT q.doc_id, q.seg, g2.h, q.idx, q.text, q.w FROM q JOIN g1 USING (doc_id, seg, i) JOIN g2 ON g2.doc_id = q.doc_id AND g2.seg = q.seg AND g2.g = g1.g),
      e AS (SELECT doc_id, seg, h, max(idx) AS idx FROM m GROUP BY ALL),
      a AS (SELECT * FROM m UNION ALL SELECT m.doc_id, m.seg, m.h + 1, m.idx, m.text, m.w FROM m JOIN e USING (doc_id, seg, h, idx) WHERE EXISTS (SELECT 1 FROM e x WHERE x.doc_id = m.doc_id AND x.seg = m.seg AND x.h = m.h + 1)),
      k AS (SELECT doc_id, seg, h, count(*) AS n_paragraphs, {estimate("sum(w)")} AS n_tokens, md5(string_agg(text, chr(10) ORDER BY idx)) AS text_md5 FROM a GROUP BY ALL)
      SELECT doc_id, concat('t', lpad((row_number() OVER (PARTITION BY doc_id ORDER BY seg, h))::VARCHAR, 4, '0')) AS id, n_paragraphs, n_tokens, text_md5 FROM k""",
    "held_out_text": f"""WITH h AS ({sets.ORACLES["held_out_chunks"]}), x AS (SELECT concat(string_agg(d.text, chr(10) || chr(10) ORDER BY h.id), chr(10)) AS t FROM h JOIN documents d ON d.doc_id = h.id)
      SELECT md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM x""",
    "stored_items": """SELECT concat('q', item_id) AS id, md5(concat('"quoted"', chr(10), chr(9), text)) AS pergunta_md5, md5(CASE WHEN item_id % 3 > 0 THEN text ELSE '' END) AS resposta_md5,
      CASE WHEN item_id % 2 = 0 THEN 't1,t|2' ELSE '' END AS evidencia, CASE WHEN item_id % 5 > 0 THEN '4.2' ELSE '-' END AS tema_id, true AS not_reviewed FROM benchmark""",
}
