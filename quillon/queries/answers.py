"""What answers say, and how they are scored. Replies are made from the tables so that every form occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import alignment, metrics, verify
from .common import strip, table, tokens, words

PHRASE = "De là"


def abstention_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.abstains(F.col("text"), F.lit(PHRASE)).alias("abstained"))


# Forms in which a reply may name section {s} and page {p}.
FORMS = ["{t} (seção {s}, p. {p}).", "{t} Ver SEÇÃO {s} - página {p}", "{t} (fonte: secao {s})", "{t} conforme pág. {p}.", "{t} (seção {{{s}}}, p. {{{p}}})", "{t}"]


def _replies(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    section, page = F.concat((1 + i % 7).cast("string"), F.lit("."), (1 + i % 3).cast("string")), (1 + i % 11).cast("string")
    text = F.regexp_replace("text", r"[.\s]+$", "")
    said = F.lit("")
    for k, form in enumerate(FORMS):
        said = F.when(i % len(FORMS) == k, T.fill(form, t=text, s=section, p=page)).otherwise(said)
    return table(spark, sf_dir, "benchmark").select(i.alias("q_id"), said.alias("answer"), text.alias("text"))


def citation_extract(spark, sf_dir):
    t = _replies(spark, sf_dir).withColumn("c", T.citations(F.col("answer")))
    return t.select("q_id", F.size("c").cast("bigint").alias("n"), F.coalesce(F.get("c", F.lit(0))["section"], F.lit("")).alias("section"), F.coalesce(F.get("c", F.lit(0))["page"], F.lit(-1)).alias("page"))


def citation_valid(spark, sf_dir):
    """Chunks of section (1 + id % 7).1 or .2, pages 1 to 6."""
    i = F.col("q_id")
    chunk = lambda n: F.struct(F.concat((1 + i % 7).cast("string"), F.lit(f".{n}")).alias("section_id"), F.lit(1).alias("page_start"), F.lit(6).alias("page_end"))
    t = _replies(spark, sf_dir).withColumn("chunks", F.array(chunk(1), chunk(2)))
    return verify.verified(t).select("q_id", "abstained", "cited", "source_valid")


def strip_citations(spark, sf_dir):
    return _replies(spark, sf_dir).select("q_id", F.md5(T.without_citations(F.col("answer"))).alias("plain"))


def think_removed(spark, sf_dir):
    """Messages behind a closed block, an open one, a lone closing tag, or none."""
    i = F.col("turn") % 4
    raw = F.when(i == 0, F.concat(F.lit("<think>a\nb</think>\n\n"), F.col("text"))).when(i == 1, F.concat(F.col("text"), F.lit("<think>never closed"))).when(i == 2, F.concat(F.lit("hm</think>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.without_thinking(raw)).alias("plain"))


def json_objects(spark, sf_dir):
    """The object of an event's properties, inside other text; every seventh is broken."""
    raw = F.concat(F.lit("Here:\n"), F.col("props"), F.when(F.col("event_id") % 7 == 0, F.lit(" and }")).otherwise(F.lit(" done")))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(raw, "k int").isNotNull().alias("valid"))


def evidence_ids(spark, sf_dir):
    raw = F.concat(F.lit("t"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit(" | t12, (t"), (F.col("doc_id") % 5).cast("string"), F.lit(") x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.evidence_ids(raw), ",").alias("ids"))


def normalize_em_f1(spark, sf_dir):
    """Each message against the one before it, and every third against itself with more around it."""
    t = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = t.select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The '"), F.col("text"), F.lit("' 1.5"))).otherwise(before).alias("ref")).where("ref is not null")
    return t.select("conv_id", "turn", F.md5(T.answer_text(F.col("text"))).alias("normalised"), metrics.exact_match(F.col("text"), F.col("ref")).alias("em"), F.round(metrics.token_f1(F.col("text"), F.col("ref")), 6).alias("f1"))


def _scored(spark, sf_dir) -> DataFrame:
    """Events as scored responses: their type a configuration, their user a question."""
    i = F.col("event_id")
    able, quiet = i % 5 != 0, i % 7 == 0
    t = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"),
        F.when(F.floor(i / 2) % 2 == 0, "base").otherwise("ajustado").alias("leitor"),
        F.col("user_id").cast("string").alias("q_id"),
        able.alias("answerable"),
        quiet.alias("absteve"),
        (i % 3 == 0).alias("fonte_valida"),
        F.col("value").alias("latencia_s"),
        F.when(able, F.when(quiet, 0).otherwise((i % 4 == 0).cast("int"))).alias("em"),
        F.when(able, F.when(quiet, 0.0).otherwise(i % 11 / 10)).alias("f1_tokens"),
        F.lit(None).cast("double").alias("bertscore_f1"),
        F.when(able, (i % 2).cast("int")).alias("recall"),
        F.when(able, 1.0 / (1 + i % 5)).alias("mrr"),
    )
    return t


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def metrics_by_config(spark, sf_dir):
    ppl = spark.createDataFrame([("base", 12.5), ("ajustado", 9.25)], "leitor string, perplexidade double")
    return _rounded(metrics.aggregated(_scored(spark, sf_dir), 5, ppl))


def recall_by_config(spark, sf_dir):
    return _rounded(metrics.recall_by_config(metrics.aggregated(_scored(spark, sf_dir))))


def error_kinds(spark, sf_dir):
    return metrics.error_kind(_scored(spark, sf_dir))


def paired_means(spark, sf_dir):
    t = metrics.paired(_scored(spark, sf_dir)).groupBy("config", "metrica")
    return _rounded(t.agg(F.count("*").alias("n_perguntas"), F.avg("first").alias("media_base"), F.avg("second").alias("media_ajustado"), F.avg(F.col("second") - F.col("first")).alias("ganho_medio")))


def paired_gain(spark, sf_dir):
    """With the numpy bootstrap, which SQL can't repeat."""
    return _rounded(metrics.paired_gain(_scored(spark, sf_dir)))


def paired_gain_bootstrap(spark, sf_dir):
    pairs = metrics.paired(_scored(spark, sf_dir)).select("config", "metrica", "q_id", F.round(F.col("second") - F.col("first"), 6).alias("gain"))
    return _rounded(metrics.hashed_bootstrap(pairs, ["config", "metrica"], "gain", "q_id", 1000, block=64), 5)


def latency_quantiles(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("event_type")
    return _rounded(t.agg(F.percentile("value", F.lit(0.5)).alias("median_s"), F.percentile("value", F.lit(0.95)).alias("p95_s"), F.count("*").alias("n")))


def agreement_kappa(spark, sf_dir):
    """Agreement of the quality labels with the absence of the toxic ones."""
    t = table(spark, sf_dir, "labels")
    a, b = t.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), t.select(F.col("doc_id").alias("id"), (1 - F.col("toxic")).alias("label"))
    return _rounded(metrics.kappa(a, b))


def token_alignment(spark, sf_dir):
    """How well each message covers the one before it, words weighing by their rarity among those."""
    t = table(spark, sf_dir, "conversations")
    pairs = t.select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("pred"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("ref"))
    found = alignment.alignment(pairs, "key", alignment.inverse_frequencies(pairs, "ref"))
    return _rounded(found.select("key.*", "precision", "recall", "f1"), 5)


QUERIES = {f.__name__: f for f in (abstention_detect, citation_extract, citation_valid, strip_citations, think_removed, json_objects, evidence_ids, normalize_em_f1, metrics_by_config, recall_by_config, error_kinds, paired_means, paired_gain, paired_gain_bootstrap, latency_quantiles, agreement_kappa, token_alignment)}

_LITTLE = ", ".join(f"'{w}'" for w in T.LITTLE_WORDS)


def _normal(x: str) -> str:
    x = f"regexp_replace(lower({x}), '(\\p{{Nd}})[.,](\\p{{Nd}})', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '(\\p{{Nd}})[.,](\\p{{Nd}})', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s\\x{{85}}\\x{{a0}}\\p{{Z}}]|_', ' ', 'g')"
    return f"list_filter({words(x)}, lambda y: NOT list_contains([{_LITTLE}], y))"


def _plain(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')")


_BARE = "regexp_replace(text, '[.\\s]+$', '')"
_SCORED = """e AS (SELECT event_type AS config, CASE WHEN event_id // 2 % 2 = 0 THEN 'base' ELSE 'ajustado' END AS leitor, user_id::VARCHAR AS q_id, event_id % 5 <> 0 AS able, event_id % 7 = 0 AS quiet, event_id % 3 = 0 AS valid, value,
    CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 4 = 0)::INT END AS em0, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE event_id % 11 / 10.0::DOUBLE END AS f10, event_id % 2 AS recall0, 1.0::DOUBLE / (1 + event_id % 5) AS mrr0 FROM events)"""
_PAIRED = f"""{_SCORED}, m AS (SELECT config, q_id, avg(em0) FILTER (leitor = 'base') AS eb, avg(em0) FILTER (leitor = 'ajustado') AS ea, avg(f10) FILTER (leitor = 'base') AS fb, avg(f10) FILTER (leitor = 'ajustado') AS fa FROM e WHERE able GROUP BY ALL HAVING eb IS NOT NULL AND ea IS NOT NULL),
  pr AS (SELECT config, q_id, 'em' AS metrica, eb AS b, ea AS a FROM m UNION ALL SELECT config, q_id, 'f1_tokens', fb, fa FROM m)"""
_METRICS = """SELECT config, leitor, count(*) AS n, round(avg(em0) FILTER (able), 6) AS em, round(avg(f10) FILTER (able), 6) AS f1_tokens, NULL::DOUBLE AS bertscore_f1, round(avg(recall0) FILTER (able), 6) AS recall_at_5, round(avg(mrr0) FILTER (able), 6) AS mrr_at_5,
  round(avg(quiet::INT) FILTER (NOT able), 6) AS abst_correta, round(avg(quiet::INT) FILTER (able), 6) AS abst_indevida, round(1 - avg(quiet::INT) FILTER (NOT able), 6) AS alucinacao_sem_resposta, round(avg(valid::INT) FILTER (NOT quiet), 6) AS fonte_valida_pct,
  round(quantile_cont(value, 0.5), 6) AS latencia_mediana_s, round(quantile_cont(value, 0.95), 6) AS latencia_p95_s, CASE leitor WHEN 'base' THEN 12.5::DOUBLE ELSE 9.25::DOUBLE END AS perplexidade FROM e GROUP BY config, leitor"""

ORACLES = {
    "abstention_detect": f"SELECT doc_id, contains({_plain('text')}, 'de la') AS abstained FROM documents",
    "citation_extract": """SELECT item_id AS q_id, CASE WHEN item_id % 6 = 5 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN item_id % 6 IN (3, 5) THEN '' ELSE concat(1 + item_id % 7, '.', 1 + item_id % 3) END AS section,
      CASE WHEN item_id % 6 IN (2, 5) THEN -1 ELSE 1 + item_id % 11 END::INT AS page FROM benchmark""",
    "citation_valid": """SELECT item_id AS q_id, false AS abstained, item_id % 6 <> 5 AS cited,
      item_id % 6 <> 5 AND (item_id % 6 = 3 OR item_id % 3 < 2) AND (item_id % 6 = 2 OR item_id % 11 < 6) AS source_valid FROM benchmark""",
    "strip_citations": f"""WITH t AS (SELECT item_id, {_BARE} AS text FROM benchmark), c AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN text || '.' WHEN 1 THEN text || ' Ver' WHEN 3 THEN concat(text, ' conforme pág. ', 1 + item_id % 11, '.') ELSE text END AS x FROM t)
      SELECT item_id AS q_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '[\\s\\p{{Z}}]+([.,;:!?])', '\\1', 'g'), '[\\s\\p{{Z}}]{{2,}}', ' ', 'g'), '^[ \\n\\-–]+|[ \\n\\-–]+$', '', 'g')) AS plain FROM c""",
    "think_removed": "SELECT conv_id, turn, md5(text) AS plain FROM conversations",
    "json_objects": "SELECT event_id, event_id % 7 <> 0 AS valid FROM events",
    "evidence_ids": "SELECT doc_id, concat('t', lpad(doc_id::VARCHAR, 4, '0'), ',t12,t', doc_id % 5) AS ids FROM documents",
    "normalize_em_f1": f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN concat('The ''', text, ''' 1.5') ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS ref FROM conversations),
      w AS (SELECT conv_id, turn, {_normal("text")} AS p, {_normal("ref")} AS r FROM c WHERE ref IS NOT NULL),
      b AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda y: y = t))))), 0) AS c FROM w)
      SELECT conv_id, turn, md5(array_to_string(p, ' ')) AS normalised, (p = r)::INT AS em, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT::DOUBLE ELSE 2.0::DOUBLE * c / (len(p) + len(r)) END, 6) AS f1 FROM b""",
    "token_alignment": f"""WITH k AS (SELECT conv_id, turn, text AS p, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
      t AS (SELECT conv_id, turn, p, r, CASE WHEN len({tokens("p")}) > 0 THEN {tokens("p")} ELSE [p] END AS tp, CASE WHEN len({tokens("r")}) > 0 THEN {tokens("r")} ELSE [r] END AS tr FROM k),
      df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(tr)) AS w FROM t WHERE r IS NOT NULL) GROUP BY w),
      idf AS (SELECT w, ln(((SELECT count(*) FROM t WHERE r IS NOT NULL) + 1) / (df + 1)::DOUBLE) AS idf FROM df),
      e AS (SELECT conv_id, turn, false AS side, unnest(tp) AS w FROM t WHERE p IS NOT NULL AND r IS NOT NULL UNION ALL SELECT conv_id, turn, true, unnest(tr) FROM t WHERE p IS NOT NULL AND r IS NOT NULL),
      c AS (SELECT conv_id, turn, side, w, count(*) * coalesce(any_value(idf), (SELECT max(idf) FROM idf)) AS weight FROM e LEFT JOIN idf USING (w) GROUP BY ALL),
      g AS (SELECT w, (('0x' || right(md5(substr('<' || w || '>', i, 3)), 3))::INT % 1024) AS b, count(*) AS n FROM (SELECT w, unnest(range(1, greatest(1, length(w)) + 1)) AS i FROM (SELECT DISTINCT w FROM e)) GROUP BY ALL),
      l AS (SELECT w, sqrt(sum(n * n)) AS l FROM g GROUP BY w),
      xy AS (SELECT DISTINCT a.w AS x, b.w AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn AND NOT a.side AND b.side),
      d AS (SELECT x, y, sum(a.n * b.n) AS dot FROM xy JOIN g a ON a.w = x JOIN g b ON b.w = y AND b.b = a.b GROUP BY ALL),
      s AS (SELECT x, y, dot / (a.l * b.l) AS cosine FROM d JOIN l a ON a.w = x JOIN l b ON b.w = y),
      m AS (SELECT a.conv_id, a.turn, x, y, cosine FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn AND NOT a.side AND b.side JOIN s ON x = a.w AND y = b.w),
      best AS (SELECT conv_id, turn, false AS side, x AS w, max(cosine) AS cosine FROM m GROUP BY ALL UNION ALL SELECT conv_id, turn, true, y, max(cosine) FROM m GROUP BY ALL),
      f AS (SELECT conv_id, turn, c.side, sum(weight * coalesce(cosine, 0)) / nullif(sum(weight), 0) AS mean FROM c LEFT JOIN best USING (conv_id, turn, side, w) GROUP BY ALL),
      o AS (SELECT conv_id, turn, coalesce(any_value(mean) FILTER (NOT side), 0) AS p, coalesce(any_value(mean) FILTER (side), 0) AS r FROM f GROUP BY ALL)
      SELECT conv_id, turn, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1 FROM o""",
    "metrics_by_config": f"WITH {_SCORED} {_METRICS}",
    "recall_by_config": f"WITH {_SCORED}, m AS (SELECT config, leitor, avg(recall0) FILTER (able) AS r FROM e GROUP BY ALL) SELECT config, round(avg(r), 6) AS recall_at_5 FROM m GROUP BY config",
    "error_kinds": f"""WITH {_SCORED} SELECT config, leitor, CASE WHEN NOT able AND NOT quiet THEN 'hallucination' WHEN NOT able THEN 'right abstention' WHEN recall0 = 0 THEN 'retrieval miss' WHEN quiet THEN 'undue abstention' WHEN em0 = 1 THEN 'right'
      WHEN f10 = 0 THEN 'reading failure' ELSE 'partly right' END AS error, count(*) AS n FROM e GROUP BY ALL""",
    "paired_means": f"WITH {_PAIRED} SELECT config, metrica, count(*) AS n_perguntas, round(avg(b), 6) AS media_base, round(avg(a), 6) AS media_ajustado, round(avg(a - b), 6) AS ganho_medio FROM pr GROUP BY ALL",
    "paired_gain_bootstrap": f"""WITH {_PAIRED}, v AS (SELECT config, metrica, list(round(a - b, 6) ORDER BY q_id) AS v FROM pr GROUP BY ALL),
      d AS (SELECT config, metrica, r, (('0x' || left(md5(concat('42:', r, ':', i)), 8))::BIGINT % len(v)) // 64 AS b, count(*) AS c FROM (SELECT *, unnest(range(len(v))) AS i FROM v), (SELECT unnest(range(1000)) AS r) GROUP BY ALL),
      s AS (SELECT config, metrica, r, v, list_sum(list_transform(range(c), lambda k: v[1 + b * 64 + (('0x' || left(md5(concat('42:', r, ':', b, ':', k)), 8))::BIGINT % least(64, len(v) - b * 64))])) AS s FROM d JOIN v USING (config, metrica)),
      w AS (SELECT config, metrica, r, sum(s) / any_value(len(v)) AS draw FROM s GROUP BY ALL)
      SELECT config, metrica, round(any_value(list_avg(v)), 5) AS mean, round(quantile_cont(draw, 0.025), 5) AS low, round(quantile_cont(draw, 0.975), 5) AS high FROM w JOIN v USING (config, metrica) GROUP BY config, metrica""",
    "latency_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_s, round(quantile_cont(value, 0.95), 6) AS p95_s, count(*) AS n FROM events GROUP BY event_type",
    "agreement_kappa": """WITH t AS (SELECT quality AS x, 1 - toxic AS y FROM labels), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS o FROM t), c AS (SELECT sum(r * s) AS e FROM (SELECT x AS l, count(*) AS r FROM t GROUP BY x) JOIN (SELECT y AS l, count(*) AS s FROM t GROUP BY y) USING (l))
      SELECT n, round(o, 6) AS observed, round(coalesce(e, 0) / (n * n)::DOUBLE, 6) AS expected, round((o - coalesce(e, 0) / (n * n)::DOUBLE) / (1 - coalesce(e, 0) / (n * n)::DOUBLE), 6) AS kappa FROM n, c""",
}
