"""Sampling, review, splitting, resumption. Documents stand for chunks and items, their sources for sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gold
from ..operators import retrieval as R
from ..plans import jobs
from .common import estimate, table, words

PHRASE = "Não encontrado no manual"


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), T.token_estimate(F.size(T.words(F.col("text")))).alias("n_tokens"), "text")


def stratified_sample(spark, sf_dir):
    able = _chunks(spark, sf_dir).where(F.col("n_tokens") >= gold.MIN_SAMPLE_TOKENS)
    return gold.stratified_sample(able, 150, "section_id").select("id", "section_id")


def sampling_tasks(spark, sf_dir):
    return gold.tasks(_chunks(spark, sf_dir), 50).select("id", "section_id", "kind", F.col("place").cast("bigint").alias("place"))


def _items(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("doc_id") % 9 == 0, gold.UNANSWERABLE).otherwise("factual")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("tema_id"), kind.alias("tipo"))


def group_split(spark, sf_dir):
    return gold.split(_items(spark, sf_dir), 0.3, 42).select("doc_id", "tema_id", "split")


def held_out_chunks(spark, sf_dir):
    test = gold.split(_items(spark, sf_dir), 0.3, 42).where("split = 'test'")
    return gold.held_out_chunks(_chunks(spark, sf_dir), test, 30, 42).select("id", "section_id")


def _review(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (i % n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("line"),
        F.concat(F.lit("q"), (F.floor(i / 50) * 50 + F.least(i % 50, F.lit(47))).cast("string")).alias("id"),
        pick(7, "factual", "procedimental", "sem_resposta", "other", "factual ").alias("tipo"),
        F.col("source").alias("tema_id"),
        F.when(i % 11 > 0, F.concat(F.lit("t"), F.lpad(i.cast("string"), 4, "0"), F.lit("|t7"))).alias("evidencia"),
        F.col("text").alias("pergunta"),
        F.col("lang").alias("resposta_ref"),
        pick(13, "aceitar", "EDITAR", "descartar", "", "maybe", "aceitar ", "aceitar").alias("decisao"),
        F.when(i % 3 == 0, " new? ").alias("pergunta_corrigida"),
        F.when(i % 4 == 0, "better").alias("resposta_corrigida"),
    )


def review_apply(spark, sf_dir):
    t = gold.reviewed(_review(spark, sf_dir), PHRASE)
    return t.select("line", "id", F.md5("pergunta").alias("pergunta"), "resposta_ref", F.array_join("evidencia", "|").alias("evidencia"), "tipo", "tema_id", "origem", F.coalesce("error", F.lit("")).alias("error"), "kept")


def review_table(spark, sf_dir):
    """Candidates with none, one or two evidence chunks, and the texts that a reviewer sees."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    cands = docs.select(
        F.concat(F.lit("q"), i.cast("string")).alias("id"),
        F.when(i % 5 == 0, gold.UNANSWERABLE).otherwise("factual").alias("tipo"),
        F.col("source").alias("tema_id"),
        F.when(i % 5 == 0, none).when(i % 5 == 1, F.array(F.col("doc_id").cast("string"), (i - 1).cast("string"))).otherwise(F.array(i.cast("string"))).alias("evidencia"),
        F.col("lang").alias("pergunta"),
        F.lit("a").alias("resposta_ref"),
        i.cast("string").alias("trecho_origem"),
    )
    t = gold.review_table(cands, docs.select(i.cast("string").alias("id"), "text"))
    return t.select("id", "tipo", "evidencia", F.md5("texto_evidencia").alias("texto"))


def gold_validate(spark, sf_dir):
    i = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(
        i.alias("line"),
        F.when(i % 17 > 0, F.concat(F.lit("q"), (i - i % 10 + F.least(i % 10, F.lit(8))).cast("string"))).alias("id"),
        F.col("lang").alias("pergunta"),
        F.when(i % 13 > 0, F.lit("a")).alias("resposta_ref"),
        F.array(i.cast("string")).alias("evidencia"),
        F.when(i % 7 == 3, "odd").otherwise("factual").alias("tipo"),
    )
    return gold.violations(items, "line").select("line", "error")


def grid_resume(spark, sf_dir):
    """Cells of two readers, four configurations, two repeats and all questions that aren't done."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("pergunta"), F.lit("factual").alias("tipo"))
    cells = jobs.pending(items, ["S0", "S1", "S2", "S3"], ["base", "ajustado"], 2, None)
    done = cells.where((F.col("q_id") + F.col("repeticao")) % 3 == 0)
    return jobs.pending(items, ["S0", "S1", "S2", "S3"], ["base", "ajustado"], 2, done).select("config", "leitor", "q_id", "repeticao")


def generated_candidates(spark, sf_dir):
    """Candidates from replies of which some hold no object, and some an empty question."""
    asked = gold.tasks(_chunks(spark, sf_dir), 50)
    p = F.col("place")
    reply = F.when(p % 6 == 0, F.lit("no object")).when(p % 6 == 1, F.concat(F.lit('x {"pergunta": "q'), p.cast("string"), F.lit('", "resposta": "a"} y'))).when(p % 6 == 2, F.lit('{"pergunta": " ", "resposta": "a"}')).otherwise(F.concat(F.lit('{"pergunta": "q'), p.cast("string"), F.lit('", "resposta": " a "}')))
    made = gold.candidates(asked, asked.select("place", F.lit(0).alias("attempt"), reply.alias("reply")), PHRASE)
    return made.select("id", "pergunta", "resposta_ref", F.size("evidencia").cast("bigint").alias("n_evidence"), "tipo", "tema_id", "trecho_origem")


def training_examples(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), F.col("lang").alias("answer"))
    return gold.training_examples(t).select("id", "part")


def training_set(spark, sf_dir):
    """Prompts and answers from questions that are the first words of 300 documents."""
    chunks = _chunks(spark, sf_dir).withColumn("section", F.lit("")).withColumn("page_start", F.lit(1))
    asked = gold.training_tasks(chunks, 300)
    said = F.struct(F.array_join(F.slice(T.words(F.col("text")), 1, 8), " ").alias("pergunta"), F.concat(F.col("section_id"), F.lit(" (seção 1, p. 2).")).alias("resposta"))
    replies = asked.select("place", F.lit(0).alias("attempt"), F.to_json(said).alias("reply"))

    def search(questions: DataFrame) -> DataFrame:
        terms = R.question_terms(questions).select("term").distinct()
        return R.LexicalIndex.build(chunks, only_terms=terms).search(questions, 7)

    return gold.training_set(asked, replies, chunks, search, "{contexto}\n\n{pergunta}", PHRASE).select("id", F.md5("prompt").alias("prompt_md5"), "answer", "n_chunks", "part")


QUERIES = {f.__name__: f for f in (stratified_sample, sampling_tasks, group_split, held_out_chunks, review_apply, review_table, gold_validate, grid_resume, generated_candidates, training_examples, training_set)}

_CHUNKS = f"ch AS (SELECT doc_id AS id, source AS section_id, {estimate(f'len({words("text")})')} AS n_tokens FROM documents)"


def _sample(name: str, n: int, seed: int) -> str:
    return f"""{name}c AS (SELECT section_id AS g, count(*) AS size FROM ch WHERE n_tokens >= 120 GROUP BY 1),
  {name}t AS (SELECT *, count(*) OVER () AS groups, sum(size) OVER () AS total FROM {name}c),
  {name}b AS (SELECT *, least({n}, total) AS n, (least({n}, total) >= groups)::INT AS base FROM {name}t),
  {name}i AS (SELECT *, CASE WHEN total - base * groups > 0 THEN (n - base * groups) * (size - base)::DOUBLE / (total - base * groups) ELSE 0 END AS ideal FROM {name}b),
  {name}q AS (SELECT *, base + floor(ideal)::BIGINT AS whole, row_number() OVER (ORDER BY round(floor(ideal) - ideal, 9), md5(g), g) AS turn FROM {name}i),
  {name}u AS (SELECT *, whole + (turn <= n - sum(whole) OVER () AND whole < size)::INT AS quota FROM {name}q),
  {name} AS (SELECT id, section_id FROM (SELECT ch.*, quota, row_number() OVER (PARTITION BY section_id ORDER BY md5(concat('{seed}:', id)), id) AS k FROM ch JOIN {name}u ON g = section_id WHERE n_tokens >= 120) WHERE k <= quota)"""


_TASKS = f"""{_CHUNKS}, {_sample("s", 40, 42)}, {_sample("z", 10, 43)},
  ta AS (SELECT id, section_id, row_number() OVER (ORDER BY md5(concat('42:order:', id))) - 1 AS place FROM s UNION ALL SELECT id, section_id, row_number() OVER (ORDER BY md5(concat('43:order:', id))) + 39 FROM z),
  tk AS (SELECT *, CASE WHEN place >= 40 THEN 'sem_resposta' WHEN place % 5 IN (1, 3) THEN 'procedimental' ELSE 'factual' END AS kind FROM ta)"""
_SPLIT = """RECURSIVE g AS (SELECT source AS g, count(*) AS n, row_number() OVER (ORDER BY md5(concat('42:', source))) AS i FROM documents GROUP BY source),
  f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, '' AS g, false AS dev UNION ALL
    SELECT g.i, CASE WHEN abs(f.n + g.n - goal) < abs(f.n - goal) THEN f.n + g.n ELSE f.n END, g.g, abs(f.n + g.n - goal) < abs(f.n - goal) FROM f JOIN g ON g.i = f.i + 1, (SELECT 0.3::DOUBLE * count(*) AS goal FROM documents)),
  sp AS (SELECT g, CASE WHEN dev THEN 'dev' ELSE 'test' END AS split FROM f WHERE i > 0)"""

ORACLES = {
    "stratified_sample": f"WITH {_CHUNKS}, {_sample('s', 150, 42)} SELECT id, section_id FROM s",
    "sampling_tasks": f"WITH {_TASKS} SELECT id, section_id, kind, place::BIGINT AS place FROM tk",
    "group_split": f"WITH {_SPLIT} SELECT doc_id, source AS tema_id, split FROM documents JOIN sp ON g = source",
    "held_out_chunks": f"WITH {_SPLIT} SELECT doc_id AS id, source AS section_id FROM documents JOIN sp ON g = source WHERE split = 'dev' ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 30",
    "review_apply": """WITH r AS (SELECT doc_id AS line, concat('q', doc_id // 50 * 50 + least(doc_id % 50, 47)) AS id, trim(['factual', 'procedimental', 'sem_resposta', 'other', 'factual '][1 + doc_id % 7 % 5]) AS tipo, source AS tema_id,
        CASE WHEN doc_id % 11 > 0 THEN [concat('t', lpad(doc_id::VARCHAR, 4, '0')), 't7'] ELSE [] END AS ev, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q, lang AS a,
        lower(trim(['aceitar', 'EDITAR', 'descartar', '', 'maybe', 'aceitar ', 'aceitar'][1 + doc_id % 13 % 7])) AS d, CASE WHEN doc_id % 3 = 0 THEN 'new?' ELSE '' END AS nq, CASE WHEN doc_id % 4 = 0 THEN 'better' ELSE '' END AS na FROM documents),
      k AS (SELECT *, d IN ('aceitar', 'editar', 'descartar') AS known FROM r), s AS (SELECT *, known AND row_number() OVER (PARTITION BY id, known ORDER BY line) > 1 AS again FROM k),
      j AS (SELECT *, CASE WHEN d = '' THEN 'no decision' WHEN NOT known THEN 'unknown decision' WHEN again THEN 'repeated id' WHEN d = 'descartar' THEN '' WHEN tipo NOT IN ('factual', 'procedimental', 'sem_resposta') THEN 'unknown kind'
        WHEN d = 'editar' AND nq = '' AND na = '' THEN 'edit without a change' WHEN tipo <> 'sem_resposta' AND len(ev) = 0 THEN 'no evidence' ELSE '' END AS error FROM s)
      SELECT line, id, md5(CASE WHEN d = 'editar' AND nq <> '' THEN nq ELSE q END) AS pergunta, CASE WHEN tipo = 'sem_resposta' THEN 'Não encontrado no manual' WHEN d = 'editar' AND na <> '' THEN na ELSE a END AS resposta_ref,
        CASE WHEN tipo = 'sem_resposta' THEN '' ELSE array_to_string(ev, '|') END AS evidencia, tipo, tema_id, CASE WHEN d = 'editar' THEN 'editado' ELSE 'gerado' END AS origem, error, error = '' AND d <> 'descartar' AS kept FROM j""",
    "review_table": """SELECT concat('q', d.doc_id) AS id, CASE WHEN d.doc_id % 5 = 0 THEN 'sem_resposta' ELSE 'factual' END AS tipo, CASE d.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(d.doc_id, '|', d.doc_id - 1) ELSE d.doc_id::VARCHAR END AS evidencia,
        md5(CASE d.doc_id % 5 WHEN 0 THEN '[trecho de origem; a resposta NÃO deve estar no manual] ' || d.text WHEN 1 THEN concat(d.text, chr(10), '---', chr(10), p.text) ELSE d.text END) AS texto FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1""",
    "gold_validate": """WITH i AS (SELECT doc_id AS line, CASE WHEN doc_id % 17 > 0 THEN concat('q', doc_id - doc_id % 10 + least(doc_id % 10, 8)) END AS id, doc_id % 13 = 0 AS no_answer, doc_id % 7 = 3 AS odd FROM documents),
      r AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY id ORDER BY line) > 1 AS again FROM i)
      SELECT line, 'missing: ' || concat_ws(', ', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN no_answer THEN 'resposta_ref' END) AS error FROM r WHERE id IS NULL OR no_answer
      UNION ALL SELECT line, 'unknown kind' FROM r WHERE id IS NOT NULL AND NOT no_answer AND odd UNION ALL SELECT line, 'repeated id' FROM r WHERE id IS NOT NULL AND NOT no_answer AND again""",
    "grid_resume": """SELECT config, leitor, item_id AS q_id, r::INT AS repeticao FROM benchmark, (SELECT unnest(['S0', 'S1', 'S2', 'S3']) AS config), (SELECT unnest(['base', 'ajustado']) AS leitor), (SELECT unnest([1, 2]) AS r) WHERE (item_id + r) % 3 <> 0""",
    "generated_candidates": f"""WITH {_TASKS}, k AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM tk WHERE place % 6 NOT IN (0, 2))
      SELECT concat('q', lpad(n::VARCHAR, 3, '0')) AS id, concat('q', place) AS pergunta, CASE WHEN kind = 'sem_resposta' THEN '{PHRASE}' ELSE 'a' END AS resposta_ref, (kind <> 'sem_resposta')::BIGINT AS n_evidence, kind AS tipo, section_id AS tema_id, id AS trecho_origem FROM k""",
    "training_examples": f"""SELECT doc_id AS id, CASE WHEN ('0x' || left(md5(concat('42:', doc_id)), 8))::BIGINT / 4294967296.0::DOUBLE < 0.05 THEN 'validation' ELSE 'train' END AS part FROM documents WHERE {estimate(f"len({words("concat_ws(' ', text, lang)")})")} <= 2048""",
}
