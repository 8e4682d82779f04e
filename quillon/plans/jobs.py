"""Jobs: index a document, ask questions, evaluate with resumption.

Tables of an index lie below paths.index_dir: chunks, postings, terms, totals, vectors and manifest.json.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UserError
from ..functions import text as T
from ..operators import chunking, gold, ingest, metrics, models, verify
from ..operators import retrieval as R
from ..sources import readers, store, writers
from . import config as C
from . import prompts as P

log = logging.getLogger("quillon")

MANIFEST_VERSION = 2
#: Fewer sections than this are reported: the title pattern may not fit the document.
MIN_SECTIONS = 3

def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s}"


def _stop_words(c) -> tuple[str, ...]:
    return T.portuguese_stop_words() if c["bm25"]["remover_stopwords"] else ()


def _lexical_options(c) -> dict:
    return {"stop_words": _stop_words(c), "keep_accents": c["bm25"]["manter_acentos"]}


def build_chunks(blocks: DataFrame, n_pages: DataFrame, c) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, paragraph counts, text layer) of documents given as blocks."""
    i, t = c["ingestao"], c["trechos"]
    rows = ingest.text_blocks(blocks)
    layer = ingest.text_layer(rows, n_pages)
    ingest.require_readable(layer)
    paragraphs, counts = ingest.paragraphs(rows, n_pages, i["limiar_repeticao_cabecalho"], i["regex_titulo"], i["min_chars_paragrafo"], i["validar_sequencia_titulos"], i["remover_cabecalhos_rodapes"])
    made = chunking.chunks(paragraphs, t["max_tokens"], t["min_tokens"], t["tokens_por_palavra"], t["sobreposicao_paragrafos"])
    return made, counts, layer


def index(spark: SparkSession, blocks: DataFrame, n_pages: DataFrame, c, make_client: Callable, gold_files: tuple[str, ...] = ()) -> dict:
    """Builds and stores chunks and both indexes; returns the manifest, which names all that went into them."""
    home = c["paths"]["index_dir"]
    old = _manifest(home)
    chunks, counts, _ = build_chunks(blocks, n_pages, c)
    chunks.write.mode("overwrite").parquet(f"{home}/chunks")
    counts.write.mode("overwrite").parquet(f"{home}/counts")
    chunks = spark.read.parquet(f"{home}/chunks")
    stats = chunking.statistics(chunks, c["trechos"]["max_tokens"], c["trechos"]["min_tokens"]).first()
    if not stats.n_chunks:
        raise UserError("the document gives no chunk; see ingestao.min_chars_paragrafo")
    if stats.n_sections < MIN_SECTIONS:
        log.warning("only %d sections; see ingestao.regex_titulo", stats.n_sections)
    R.LexicalIndex.build(chunks, "id", "text", **_lexical_options(c)).save(home)
    models.embedded(chunks, make_client, c["modelos"]["embeddings"], c["denso"]["dimensao"], c["denso"]["batch_size"], normalise=c["denso"]["normalizar_l2"]).write.mode("overwrite").parquet(f"{home}/vectors")
    manifest = {"versao_manifesto": MANIFEST_VERSION, "criado_em": writers.now_iso(), "blocos": fingerprint(blocks), "trechos": fingerprint(chunks), "n_trechos": stats.n_chunks, "parametros": _parameters(c)}
    if old and old.get("trechos") != manifest["trechos"] and any(Path(p).exists() for p in gold_files):
        log.warning("chunks have changed; evidence in %s may not fit them", ", ".join(gold_files))
    writers.write_json(manifest | {"estatisticas": stats.asDict()}, f"{home}/manifest.json")
    log.info("index: %d chunks, %d sections", stats.n_chunks, stats.n_sections)
    return manifest


def _parameters(c) -> dict:
    """All that an index depends on."""
    p = C.plain(c)
    return {"ingestao": p["ingestao"], "trechos": p["trechos"], "bm25": p["bm25"], "denso": p["denso"], "embeddings": p["modelos"]["embeddings"]}


def _manifest(home: str) -> dict | None:
    f = Path(home, "manifest.json")
    return json.loads(f.read_text(encoding="utf-8")) if f.is_file() else None


class Index:
    """The stored tables, after they were found to fit the configuration, the source and each other."""

    def __init__(self, spark: SparkSession, c, blocks: DataFrame | None = None, dense: bool = True):
        home = c["paths"]["index_dir"]
        found = _manifest(home)
        if found is None:
            raise UserError(f"no index in {home}")
        self.chunks = spark.read.parquet(f"{home}/chunks")
        stale = [k for k, v in _parameters(c).items() if found["parametros"].get(k) != v]
        if blocks is not None and fingerprint(blocks) != found["blocos"]:
            stale.append("source")
        if fingerprint(self.chunks) != found["trechos"]:
            stale.append("chunks")
        if stale:
            raise UserError(f"the index in {home} is out of date ({', '.join(stale)}); build it again")
        self.lexical = R.LexicalIndex.load(spark, home)
        self.vectors = spark.read.parquet(f"{home}/vectors") if dense else None
        if dense and not (self.same_ids(self.vectors) and self.same_ids(self.lexical.postings.select("id").distinct())):
            raise UserError("chunks and indexes don't have the same ids; build the index again")

    def same_ids(self, other: DataFrame) -> bool:
        ids = self.chunks.select("id")
        return ids.join(other, "id", "left_anti").isEmpty() and other.join(ids, "id", "left_anti").isEmpty()


def numbered(vectors: DataFrame) -> DataFrame:
    """Vectors under whole numbers, for the block search: "t0042" is 42."""
    return vectors.withColumn("id", F.substring("id", 2, 18).cast("bigint"))


def chunk_name(number: Column) -> Column:
    """42 is "t0042"."""
    text = number.cast("string")
    return F.concat(F.lit("t"), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")))


def ask(questions: DataFrame, c, index_: Index | None, make_client: Callable, reader: str = "base", run_id: str = "", templates: dict[str, str] = P.DEFAULTS) -> DataFrame:
    """One response for each question (q_id, text, kind): retrieve, answer or abstain, verify.

    Embedding and search are parts of one plan with the rest, so their own seconds aren't known: they are null.
    """
    mode, spark = C.MODES[c["retriever"]], questions.sparkSession
    options = {"k1": c["bm25"]["k1"], "b": c["bm25"]["b"], **_lexical_options(c)}
    if mode == "none":
        ranked = R.retrieve("none", questions)
    else:
        lists = []
        depth = max(c["k"], c["k_candidatos_por_lista"]) if mode == "hybrid" else c["k"]
        if mode in ("lexical", "hybrid"):
            lists.append(index_.lexical.search(questions, depth, **options))
        if mode in ("dense", "hybrid"):
            v = models.embedded(questions, make_client, c["modelos"]["embeddings"], c["denso"]["dimensao"], c["denso"]["batch_size"], "q_id", normalise=c["denso"]["normalizar_l2"])
            keys = questions.select("q_id", F.xxhash64("q_id").alias("n"))
            asked = v.join(keys, v["id"] == keys["q_id"]).select(F.col("n").alias("q_id"), "vec")
            near = R.nearest(asked, numbered(index_.vectors), depth).withColumnRenamed("q_id", "n").join(keys, "n").select("q_id", chunk_name(F.col("id")).alias("id"), "score", "rank")
            lists.append(near)
        ranked = R.fused(lists, c["rrf_c"], c["k"]) if mode == "hybrid" else lists[0]
    hit = F.struct("id", "score", "rank")
    chunk_type = "struct<rank:int,section_id:string,section:string,page_start:int,page_end:int,text:string>"
    if mode == "none":
        gathered = spark.createDataFrame([], f"q_id string, recuperadas array<struct<id:string,score:double,rank:int>>, chunks array<{chunk_type}>")
    else:
        passage = F.struct("rank", "section_id", "section", "page_start", "page_end", "text")
        gathered = ranked.join(index_.chunks.drop("doc_id"), "id").groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", hit.alias("h")))).alias("hs"), F.sort_array(F.collect_list(passage)).alias("chunks"))
        gathered = gathered.select("q_id", F.transform("hs", lambda x: x["h"]).alias("recuperadas"), "chunks")
    asked = questions.withColumnRenamed("text", "pergunta").join(gathered, "q_id", "left")
    asked = asked.withColumn("recuperadas", F.coalesce("recuperadas", F.array().cast("array<struct<id:string,score:double,rank:int>>"))).withColumn("chunks", F.coalesce("chunks", F.array().cast(f"array<{chunk_type}>")))
    question = T.strip(F.col("pergunta"))
    prompt = F.when(F.size("chunks") > 0, T.fill(templates["reader"], trechos=T.context(F.col("chunks")), pergunta=question)).otherwise(T.fill(templates["reader_alone"], pergunta=question))
    quiet = verify.below_threshold(F.get("recuperadas", F.lit(0))["score"], F.lit(mode), c["abstencao"]["limiar_score"])
    asked = asked.withColumn("prompt", prompt).withColumn("quiet", quiet)
    model = C.reader_model(c, reader)
    decoding = {k: c["decodificacao"][k] for k in ("temperature", "top_p", "seed", "num_ctx", "num_predict")}
    told = models.answered(asked.where("not quiet"), make_client, model, decoding, c["decodificacao"]["think"]).drop("had_thinking")
    kept = asked.where("quiet").withColumn("prompt_tokens", F.lit(0).cast("bigint")).withColumn("reply_tokens", F.lit(0).cast("bigint")).withColumn("seconds", F.lit(0.0)).withColumn("answer", F.lit(c["abstencao"]["frase"] + "."))
    checked = verify.verified(told.unionByName(kept), c["abstencao"]["frase"])
    return checked.select(
        F.lit(run_id).alias("run_id"),
        F.lit(c["nome"]).alias("config"),
        F.lit(c["retriever"]).alias("retriever"),
        F.lit(reader).alias("leitor"),
        F.lit(model).alias("modelo"),
        "q_id",
        "pergunta",
        F.col("kind").alias("tipo"),
        "recuperadas",
        F.col("answer").alias("resposta"),
        F.col("abstained").alias("absteve"),
        F.col("cited").alias("citou_fonte"),
        F.col("source_valid").alias("fonte_valida"),
        F.transform("citations", lambda x: F.struct(x["section"].alias("tema_id"), x["page"].alias("pagina"))).alias("citacoes"),
        F.col("seconds").alias("latencia_s"),
        F.lit(None).cast("double").alias("t_embedding_s"),
        F.lit(None).cast("double").alias("t_busca_s"),
        F.col("seconds").alias("t_leitura_s"),
        F.col("prompt_tokens").cast("int").alias("n_tokens_prompt"),
        F.col("reply_tokens").cast("int").alias("n_tokens_resposta"),
    )


def candidates(chunks: DataFrame, c, make_client: Callable, n: int | None = None, templates: dict[str, str] = P.DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Candidate questions of a generator over sampled chunks, and the one row of statistics."""
    asked = gold.tasks(chunks, c["gold"]["n_candidatas"] if n is None else n, c["gold"]["frac_sem_resposta"], c["gold"]["seed"])
    none = F.col("kind") == gold.UNANSWERABLE
    asked = asked.withColumn("prompt", F.when(none, T.fill(templates["unanswerable"], texto=F.col("text"))).otherwise(T.fill(templates["question"], tipo=F.col("kind"), texto=F.col("text"))))
    options = {k: c["decodificacao"][k] for k in ("temperature", "top_p", "num_ctx")}
    replies = models.generated(asked, make_client, c["modelos"]["gerador"], options, c["gold"]["seed"])
    made = gold.candidates(asked.drop("prompt"), replies, c["abstencao"]["frase"])
    return made, gold.generation_stats(asked, replies, made)


KEY = ["config", "leitor", "q_id", "repeticao"]


def pending(items: DataFrame, configs: list[str], readers_: list[str], repeats: int, done: DataFrame | None) -> DataFrame:
    """The cells (config, leitor, q_id, repeticao) of the grid that aren't done yet."""
    spark = items.sparkSession
    grid = spark.createDataFrame([(a, b, r) for b in readers_ for a in configs for r in range(1, repeats + 1)], "config string, leitor string, repeticao int")
    cells = items.select(F.col("id").alias("q_id"), F.col("pergunta").alias("text"), F.col("tipo").alias("kind")).join(F.broadcast(grid))
    return cells if done is None else cells.join(done.select(*KEY), KEY, "left_anti")


def evaluate(spark: SparkSession, gold_path: str, configs: list, readers_: list[str], make_client: Callable, repeats: int = 1, resume: str | None = None, limit: int | None = None, bertscore: Callable | None = None, perplexity: str | None = None, templates: dict[str, str] = P.DEFAULTS) -> tuple[str, DataFrame, DataFrame]:
    """Runs the grid of readers, configurations, repeats and questions, skipping what a broken run has done.

    Returns the run's folder, the metrics and the paired gains.
    """
    if repeats < 1 or (limit is not None and limit < 1):
        raise UserError("repeats and limit must be positive")
    base = configs[0]
    items = readers.read_jsonl(spark, gold_path, readers.GOLD).withColumn("line", F.monotonically_increasing_id())
    wrong = gold.violations(items, "line").orderBy("line").limit(20).collect()
    if wrong or items.isEmpty():
        raise UserError(f"{gold_path}: " + ("; ".join(f"{r.id}: {r.error}" for r in wrong) or "no questions"))
    if limit:
        items = items.orderBy("line").limit(limit)
    told = {"gold": fingerprint(items), "configs": {c["nome"]: C.plain(c) for c in configs}, "leitores": list(readers_), "repeticoes": repeats, "limite": limit}
    run_id = resume or writers.new_run_id("avaliar")
    home = f"{base['paths']['runs_dir']}/{run_id}"
    described = Path(home, "config.json")
    if resume:
        if not described.is_file():
            raise UserError(f"no run {resume}")
        before = json.loads(described.read_text(encoding="utf-8"))
        changed = [k for k, v in json.loads(json.dumps(told)).items() if before.get(k) != v]
        if changed:
            raise UserError(f"run {resume} was begun with other values of: {', '.join(changed)}")
    else:
        writers.write_json(told | {"run_id": run_id, "criado_em": writers.now_iso()}, str(described))
    handler = writers.run_log(home)
    try:
        answers = f"{home}/respostas"
        done = readers.read_jsonl(spark, answers, readers.RESPONSE) if store.exists(spark, answers) else None
        modes = {C.MODES[c["retriever"]] for c in configs}
        index_ = Index(spark, base, dense=bool(modes & {"dense", "hybrid"})) if modes != {"none"} else None
        models.require_models(make_client(), [C.reader_model(base, r) for r in readers_])
        for reader in readers_:  # one reader after the other, so that a server loads each model once
            for c in configs:
                left = pending(items, [c["nome"]], [reader], repeats, done)
                for repeat in range(1, repeats + 1):
                    cells = left.where(F.col("repeticao") == repeat).select("q_id", "text", "kind")
                    if cells.isEmpty():
                        continue
                    writers.write_jsonl(ask(cells, c, index_, make_client, reader, run_id, templates).withColumn("repeticao", F.lit(repeat)), answers, append=True)
                    log.info("answered config=%s reader=%s repeat=%d", c["nome"], reader, repeat)
        responses = readers.read_jsonl(spark, answers, readers.RESPONSE)
        rows = metrics.scored(responses, items)
        if bertscore:
            a, cache = base["avaliacao"], f"{base['paths']['runs_dir']}/.cache/bertscore"
            known = spark.read.parquet(cache) if store.exists(spark, cache) else None
            rows = metrics.with_stored_bertscore(rows, bertscore, known, cache, getattr(bertscore, "cache_name", a["bertscore_modelo"]), a["bertscore_num_layers"])
        from ..operators.perplexity import latest

        found = latest(base["paths"]["runs_dir"], perplexity)
        ppl = None
        if found:
            values = json.loads(found.read_text(encoding="utf-8")).get("perplexidade", {})
            ppl = spark.createDataFrame(list(values.items()) or None, "leitor string, perplexidade double")
        table, gains = metrics.aggregated(rows, base["k"], ppl), metrics.paired_gain(rows, seed=base["decodificacao"]["seed"])
        writers.write_metrics(table, f"{home}/metrics")
        writers.write_metrics(gains, f"{home}/pareado")
        return home, table, gains
    finally:
        log.removeHandler(handler)
        handler.close()


SYNCED = re.compile(r"(?i)dropbox|onedrive|google ?drive|icloud|mobile documents|box sync|nextcloud|mega")


def synced_folder(path: str) -> str | None:
    """The part of a path that looks like a folder which a service copies elsewhere, if any."""
    return next((p for p in Path(path).absolute().parts if SYNCED.search(p)), None)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
