"""Retrieval over documents, benchmark passages as questions, and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics
from ..operators import retrieval as R
from ..operators import verify
from .common import table, tokens

# Words of the sample's four languages that the index leaves out.
STOP_WORDS = "the of and to in is that it de la le les et un des der die und den das el los las que en".split()
K = 5


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def _index(spark, sf_dir) -> tuple[R.LexicalIndex, DataFrame]:
    questions = _questions(spark, sf_dir)
    asked = R.question_terms(questions, STOP_WORDS).select("term").distinct()
    return R.LexicalIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", STOP_WORDS, only_terms=asked), questions


def bm25_terms(spark, sf_dir):
    """Document frequency and idf of every word of the corpus."""
    index = R.LexicalIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", STOP_WORDS)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    index, questions = _index(spark, sf_dir)
    return index.search(questions, K, stop_words=STOP_WORDS).select("q_id", "id", F.round("score", 4).alias("score"), "rank")


def _evidence(spark, sf_dir) -> DataFrame:
    return R.anchor_evidence(_questions(spark, sf_dir).withColumnRenamed("text", "anchor"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def anchor_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


def bm25_recall_mrr(spark, sf_dir):
    """Per question: its recall at five, its reciprocal rank, and the documents found."""
    index, questions = _index(spark, sf_dir)
    found = metrics.ranked_lists(index.search(questions, K, stop_words=STOP_WORDS), _evidence(spark, sf_dir), K)
    return found.select("q_id", "recall", F.round("mrr", 6).alias("mrr"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def rrf_fusion(spark, sf_dir):
    """Two lexical rankings, of depth 20, with different saturation, fused."""
    index, questions = _index(spark, sf_dir)
    both = index.searches(questions, 20, ((1.5, 0.75), (0.9, 0.4)), STOP_WORDS)
    return R.fused([both], 60, K).select("q_id", "id", "score", "rank")


def _nearest(spark, sf_dir, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.nearest(vectors.where("id % 20 = 0").withColumnRenamed("id", "q_id"), vectors, k)


def dense_topk(spark, sf_dir):
    """The vectors nearest to every twentieth one, itself included."""
    return _nearest(spark, sf_dir, K).select("q_id", "id", F.round("score", 4).alias("score"), "rank")


def dense_recall_mrr(spark, sf_dir):
    """Whether the nearest other vectors have the query's label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = _nearest(spark, sf_dir, K + 1).where("q_id <> id")
    joined = ranked.join(labels.withColumnsRenamed({"vec_id": "q_id", "label": "wanted"}), "q_id").join(labels.withColumnsRenamed({"vec_id": "id"}), "id")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"))
    first = joined.where("label = wanted").groupBy("q_id").agg(F.min("rank").alias("first"))
    return asked.join(first, "q_id", "left").select("q_id", F.col("first").isNotNull().cast("int").alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def _passages(spark, sf_dir, ranked: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), F.col("lang").alias("section"), F.lit(1).alias("page_start"), "text")
    return ranked.join(docs, "id")


def extractive_reader(spark, sf_dir):
    """The sentence of the best three documents that shares most words with the question."""
    index, questions = _index(spark, sf_dir)
    return verify.extractive_answer(questions, _passages(spark, sf_dir, index.search(questions, 3, stop_words=STOP_WORDS)))


def prompts(spark, sf_dir):
    """The numbered passages of the best two documents of each question, as a reader sees them."""
    index, questions = _index(spark, sf_dir)
    found = _passages(spark, sf_dir, index.search(questions, 2, stop_words=STOP_WORDS))
    chunks = found.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section_id", "section", "page_start", "text"))).alias("c"))
    filled = T.fill("Passages {{}}:\n{c}\n\nQuestion: {q}", c=T.context(F.col("c")), q=T.strip(F.col("text")))
    return questions.join(chunks, "q_id").select("q_id", F.md5(filled).alias("prompt_md5"), F.length(filled).cast("bigint").alias("n_chars"))


def distractors(spark, sf_dir):
    """Up to three documents beside the evidence, within a token budget, for each question with evidence."""
    questions = _questions(spark, sf_dir)
    index, sizes, evidence = R.surveyed(table(spark, sf_dir, "documents"), questions, "doc_id", "text", STOP_WORDS)
    docs = sizes.select("id", T.token_estimate(F.col("n_words")).alias("n_tokens"))
    return R.distractors(index.search(questions, 6, stop_words=STOP_WORDS), evidence, docs, 3, 2500).select("q_id", "place", "id")


_STOPPED = "list_filter({x}, lambda w: NOT list_contains([{s}], w))".format(x="{x}", s=", ".join(f"'{w}'" for w in STOP_WORDS))
_TOK = lambda x: _STOPPED.format(x=tokens(x))
_BM25 = f"""d AS (SELECT doc_id AS id, CASE WHEN len({_TOK("text")}) > 0 THEN {_TOK("text")} ELSE ['_vazio_'] END AS t FROM documents),
  n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
  p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM d) GROUP BY ALL),
  v AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY term),
  q AS (SELECT item_id AS q_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK("text")}) AS term FROM benchmark) GROUP BY ALL)"""


def _ranked(name: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    return f"""{name}s AS (SELECT q_id, id, round(sum(times * idf * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM p JOIN v USING (term) JOIN q USING (term), n GROUP BY ALL),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM {name}s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) <= {k})"""


_FLAT = lambda x: f"lower(array_to_string(list_filter(string_split_regex({x}, '[\\s\\p{{Z}}]+'), lambda w: w <> ''), ' '))"
_EVIDENCE = f"""a AS (SELECT item_id AS q_id, {_FLAT("text")} AS anchor FROM benchmark), x AS (SELECT doc_id AS id, {_FLAT("text")} AS text FROM documents),
  e AS (SELECT q_id, id, count(*) OVER (PARTITION BY q_id) AS n_chunks FROM a JOIN x ON contains(x.text, a.anchor))"""
_NEAR = """qv AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT q_id, vec_id AS id, label, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM s)"""
_PASSAGES = "m AS (SELECT q_id, rank, source AS label, text FROM r JOIN documents ON doc_id = id)"
_TERMS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"

QUERIES = {f.__name__: f for f in (bm25_terms, bm25_topk, anchor_evidence, bm25_recall_mrr, rrf_fusion, dense_topk, dense_recall_mrr, extractive_reader, prompts, distractors)}

ORACLES = {
    "bm25_terms": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM v",
    "bm25_topk": f"WITH {_BM25}, {_ranked('r', K)} SELECT q_id, id, round(score, 4) AS score, rank FROM r",
    "anchor_evidence": f"WITH {_EVIDENCE} SELECT q_id, id, n_chunks FROM e",
    "bm25_recall_mrr": f"""WITH {_BM25}, {_ranked("r", K)}, {_EVIDENCE}, h AS (SELECT e.q_id, min(rank) AS first FROM e LEFT JOIN r ON r.q_id = e.q_id AND r.id = e.id GROUP BY e.q_id),
      l AS (SELECT q_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM r GROUP BY q_id)
      SELECT q_id, (first IS NOT NULL)::INT AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, coalesce(ids, '') AS ids FROM h LEFT JOIN l USING (q_id)""",
    "rrf_fusion": f"""WITH {_BM25}, {_ranked("r", 20)}, {_ranked("z", 20, 0.9, 0.4)}, f AS (SELECT q_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT q_id, id, rank FROM r UNION ALL SELECT q_id, id, rank FROM z) GROUP BY ALL)
      SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) <= {K}""",
    "dense_topk": f"WITH {_NEAR} SELECT q_id, id, round(score, 4) AS score, rank FROM r WHERE rank <= {K}",
    "dense_recall_mrr": f"""WITH {_NEAR}, h AS (SELECT r.q_id, min(rank) FILTER (r.label = w.label) AS first FROM r JOIN embeddings w ON w.vec_id = r.q_id WHERE rank <= {K + 1} AND r.q_id <> r.id GROUP BY r.q_id)
      SELECT q_id, (first IS NOT NULL)::INT AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM h""",
    "extractive_reader": f"""WITH {_BM25}, {_ranked("r", 3)}, {_PASSAGES},
      t AS (SELECT q_id, rank, label, unnest(string_split(regexp_replace(text, '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM m),
      b AS (SELECT q_id, label, sentence, len(list_intersect({_TERMS("sentence")}, {_TERMS("benchmark.text")})) AS points, row_number() OVER (PARTITION BY q_id ORDER BY len(list_intersect({_TERMS("sentence")}, {_TERMS("benchmark.text")})) DESC, rank, pos) AS i FROM t JOIN benchmark ON item_id = q_id)
      SELECT item_id AS q_id, CASE WHEN points >= 2 THEN concat(regexp_replace(sentence, '\\.+$', ''), ' (seção ', label, ', p. 1).') ELSE '{verify.PHRASE}.' END AS answer FROM benchmark LEFT JOIN b ON b.q_id = item_id AND i = 1""",
    "prompts": f"""WITH {_BM25}, {_ranked("r", 2)}, {_PASSAGES}, g AS (SELECT q_id, string_agg(concat('[', rank, '] (seção ', label, ', p. 1) ', text), chr(10) || chr(10) ORDER BY rank) AS c FROM m GROUP BY q_id),
      f AS (SELECT q_id, concat('Passages {{}}:', chr(10), c, chr(10), chr(10), 'Question: ', regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS x FROM g JOIN benchmark ON item_id = q_id)
      SELECT q_id, md5(x) AS prompt_md5, length(x)::BIGINT AS n_chars FROM f""",
}
