"""Command line: python -m quillon.plans.cli COMMAND. Thin wrappers over the jobs; exit codes 0, 1, 2 and 130."""

from __future__ import annotations

import argparse
import importlib.metadata
import importlib.util
import json
import logging
import platform
import socket
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import UserError
from ..operators import gold, models, perplexity
from ..operators.alignment import alignment_f1
from ..operators import retrieval as R
from ..sources import readers, writers
from . import config as C
from . import jobs
from . import prompts as P


VERSION = "0.2"


def session() -> SparkSession:
    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def client_maker(c):
    """What makes a client in each task: the server's, or the deterministic stand-in for the host ``hash``."""
    host, timeout, dimension = c["ollama"]["host"], c["ollama"]["timeout_s"], c["denso"]["dimensao"]
    if host.endswith("://hash"):
        return lambda: models.HashClient(dimension, models=C.plain(c)["modelos"].values())
    models.local_address(host)
    return lambda: models.HttpClient(host, timeout)


def guard(path: str, allowed: bool) -> None:
    if (found := jobs.synced_folder(path)) and not allowed:
        raise UserError(f"{path} lies in {found}, which is copied elsewhere; --permitir-pasta-sincronizada allows it")


def unwritten(path: str, force: bool) -> str:
    if Path(path).exists() and not force:
        raise UserError(f"{path} exists; --forcar replaces it")
    return path


def cmd_indexar(a, c) -> None:
    spark = session()
    readers.require_file(a.manual, (".pdf", ".parquet")) if Path(a.manual).is_file() else None
    guard(c["paths"]["index_dir"], a.permitir_pasta_sincronizada)
    if a.manual.lower().endswith(".pdf"):
        blocks, n_pages = readers.read_pdf_blocks(spark, a.manual)
    else:
        blocks = spark.read.parquet(a.manual)
        n_pages = blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    made = jobs.index(spark, blocks, n_pages, c, client_maker(c), (c["paths"]["gold_dev"], c["paths"]["gold_test"]))
    print(f"{made['n_trechos']} chunks in {c['paths']['index_dir']}")
    if a.reservar_ppl:
        chunks = spark.read.parquet(f"{c['paths']['index_dir']}/chunks")
        _reserve(spark, chunks, c, a.reservar_ppl)


def _reserve(spark, chunks, c, n: int) -> None:
    test = c["paths"]["gold_test"]
    items = readers.read_jsonl(spark, test, readers.GOLD) if Path(test).exists() else spark.createDataFrame([], readers.GOLD)
    kept = gold.held_out_chunks(chunks, items, n, c["gold"]["seed"])
    writers.write_held_out(gold.held_out_text(kept), c["paths"]["ppl_holdout"])


def cmd_recuperar(a, c) -> None:
    if a.k is not None and a.k < 1:
        raise UserError("k must be positive")
    spark, k = session(), a.k or c["k"]
    mode = C.MODES[a.modo]
    index = jobs.Index(spark, c, dense=mode in ("dense", "hybrid"))
    asked = spark.createDataFrame([("q", a.pergunta)], "q_id string, text string")
    options = {"k1": c["bm25"]["k1"], "b": c["bm25"]["b"], **jobs._lexical_options(c)}
    dense = None
    if mode in ("dense", "hybrid"):
        v = models.embedded(asked, client_maker(c), c["modelos"]["embeddings"], c["denso"]["dimensao"], id_col="q_id", normalise=c["denso"]["normalizar_l2"])
        dense = (v.select(F.lit(0).cast("bigint").alias("q_id"), "vec"), jobs.numbered(index.vectors))
        lexical = index.lexical.search(asked, max(k, c["k_candidatos_por_lista"]), **options).select(F.lit(0).cast("bigint").alias("q_id"), F.substring("id", 2, 18).cast("bigint").alias("id"), "score", "rank")
        near = R.nearest(*dense, max(k, c["k_candidatos_por_lista"]) if mode == "hybrid" else k)
        found = R.fused([lexical, near], c["rrf_c"], k) if mode == "hybrid" else near
        found = found.withColumn("id", jobs.chunk_name(F.col("id")))
    else:
        found = R.retrieve(mode, asked, index.lexical, k=k, **options)
    rows = found.join(index.chunks, "id").orderBy("rank").select("rank", "id", "score", "section_id", "page_start", F.substring("text", 1, 100).alias("t")).collect()
    for r in rows:
        print(f"{r.rank:>2}. {r.id}  {r.score:.4f}  {r.section_id or '-'}  p. {r.page_start}  {r.t!r}")
    print(f"{len(rows)} found")


def cmd_perguntar(a, c) -> None:
    if (a.pergunta is None) == (a.arquivo is None):
        raise UserError("either --pergunta or --arquivo is needed")
    spark = session()
    asked = spark.createDataFrame([("u001", a.pergunta)], "q_id string, text string") if a.pergunta is not None else readers.read_questions(spark, str(readers.require_file(a.arquivo, (".txt",))))
    make = client_maker(c)
    models.require_models(make(), [C.reader_model(c, a.leitor)])
    index = jobs.Index(spark, c, dense=C.MODES[c["retriever"]] in ("dense", "hybrid")) if c["retriever"] != "nenhum" else None
    run_id = writers.new_run_id(c["nome"], a.leitor)
    home = f"{c['paths']['runs_dir']}/{run_id}"
    writers.write_json({"run_id": run_id, "criado_em": writers.now_iso(), "leitor": a.leitor, "config": C.plain(c)}, f"{home}/config.json")
    writers.write_jsonl(jobs.ask(asked.withColumn("kind", F.lit(None).cast("string")), c, index, make, a.leitor, run_id, P.load(a.modelos_de_texto)), f"{home}/respostas")
    for r in readers.read_jsonl(spark, f"{home}/respostas", readers.RESPONSE).orderBy("q_id").collect():
        print(f"{r.q_id}: {r.resposta}  [{', '.join(x.id for x in r.recuperadas)}] source {'valid' if r.fonte_valida else 'not valid'}, {r.latencia_s:.1f} s")
    print(home)


def _chunks(spark, a, c):
    """Those of a file of lines, or of the index."""
    return readers.read_chunks(spark, a.trechos) if a.trechos else spark.read.parquet(f"{c['paths']['index_dir']}/chunks")


def cmd_gerar_perguntas(a, c) -> None:
    spark = session()
    out = unwritten(a.saida, a.forcar)
    made, stats = jobs.candidates(_chunks(spark, a, c), c, client_maker(c), a.n, P.load(a.modelos_de_texto))
    writers.write_jsonl(made, out)
    print(json.dumps(stats.first().asDict()))


def cmd_exportar_revisao(a, c) -> None:
    spark = session()
    cands = readers.read_jsonl(spark, a.candidatas, readers.GOLD + ", trecho_origem string")
    writers.write_review(gold.review_table(cands, _chunks(spark, a, c)), unwritten(a.saida, a.forcar))


def cmd_importar_revisao(a, c) -> None:
    spark = session()
    items = gold.imported(readers.read_review(spark, a.csv), c["abstencao"]["frase"])
    if a.dividir:
        sides = gold.split(items, c["gold"]["frac_dev"], c["gold"]["seed"])
        for side, path in (("dev", c["paths"]["gold_dev"]), ("test", c["paths"]["gold_test"])):
            writers.write_jsonl(sides.where(F.col("split") == side), unwritten(path, a.forcar))
    else:
        writers.write_jsonl(items, unwritten(str(Path(c["paths"]["gold_dev"]).with_name("gold_revisado.jsonl")), a.forcar))
    if a.reservar_ppl:
        _reserve(spark, spark.read.parquet(f"{c['paths']['index_dir']}/chunks"), c, a.reservar_ppl)
    print(f"{items.count()} items")


def cmd_perplexidade(a, c) -> None:
    text = str(readers.require_file(a.texto or c["paths"]["ppl_holdout"], (".txt",)))
    context = a.ctx if a.ctx is not None else c["avaliacao"]["ppl_ctx"]
    weights = {r: perplexity.stored_weights(C.reader_model(c, r)) if w == "ollama" else w for r, w in (("base", a.gguf_base), ("ajustado", a.gguf_ajustado))}
    found = {r: perplexity.measure(a.binario, w, text, context) for r, w in weights.items()}
    run_id = writers.new_run_id("perplexidade")
    home = f"{c['paths']['runs_dir']}/{run_id}"
    writers.write_json({"run_id": run_id, "criado_em": writers.now_iso(), "ctx": context, "perplexidade": found, "texto": text, "texto_sha256": jobs.file_digest(text), "gguf": weights}, f"{home}/perplexidade.json")
    print(json.dumps(found))


def cmd_avaliar(a, c) -> None:
    base = [a.config, a.sobrescrever]
    configs = [C.load(*base, n, name=n) for n in a.configs or c["avaliacao"]["configs"]]
    home, table, gains = jobs.evaluate(session(), a.gold, configs, a.leitores or list(c["avaliacao"]["leitores"]), client_maker(c), a.repeticoes or c["avaliacao"]["repeticoes"], a.retomar, a.limite, alignment_f1 if a.alinhamento else None, a.perplexidade, P.load(a.modelos_de_texto))
    for df in (table, gains):
        print(writers.markdown(df))
    print(home)


def cmd_smoke(a, c) -> int:
    failed = 0

    def item(ok: bool, text: str) -> None:
        nonlocal failed
        failed += not ok
        print(f"[{'ok' if ok else 'failed'}] {text}")

    print(f"Python {platform.python_version()} on {platform.platform()}")
    for package in ("pyspark", "pyarrow", "numpy", "pandas"):
        item(True, f"{package} {importlib.metadata.version(package)}")
    spark = session()
    docs = spark.createDataFrame([("t1", "porto carga"), ("t2", "navio atracação")], "id string, text string")
    asked = spark.createDataFrame([(1, "navio")], "q_id long, text string")
    item([r.id for r in R.LexicalIndex.build(docs).search(asked).collect()] == ["t2"], "lexical search")
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, vec array<float>")
    item(R.nearest(eye.where("id = 2").withColumnRenamed("id", "q_id"), eye, 1).first().id == 2, "vector search")
    if a.sem_rede:
        item(not _reaches_out(), "no way out to other machines")
    try:
        client = client_maker(c)()
        for m in C.plain(c)["modelos"].values():
            item(not models.missing_models([m], client.available()), f"model {m}")
        v = client.embed(c["modelos"]["embeddings"], ["x"])
        item(len(v[0]) == c["denso"]["dimensao"], f"{len(v[0])} dimensions")
    except UserError as e:
        item(False, str(e))
    if not a.sem_bertscore:
        item(importlib.util.find_spec("bert_score") is not None, "package bert_score (--sem-bertscore leaves it out)")
    return int(failed > 0)


def _reaches_out(timeout: float = 2) -> bool:
    """Whether a connection to a machine outside can be opened (an address of a public name service)."""
    try:
        socket.create_connection(("1.1.1.1", 53), timeout).close()
    except OSError:
        return False
    return True


def cmd_stats(a, c) -> None:
    f = Path(c["paths"]["index_dir"], "manifest.json")
    if not f.is_file():
        raise UserError(f"no index in {f.parent}")
    print(f.read_text(encoding="utf-8"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    top.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments) -> None:
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--sobrescrever")
        p.add_argument("-v", "--verbose", action="store_true")
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)
        p.set_defaults(run=run)

    need, flag, whole = {"required": True}, {"action": "store_true"}, {"type": int}
    templates = ("--modelos-de-texto", {"help": "folder of prompt templates"})
    readers_ = {"choices": C.READERS}
    command("indexar", cmd_indexar, ("--manual", need), ("--reservar-ppl", whole), ("--max-tokens", whole), ("--sobreposicao-paragrafos", whole), ("--permitir-pasta-sincronizada", flag))
    command("recuperar", cmd_recuperar, ("--modo", {"choices": list(C.MODES), "default": "hibrido"}), ("--pergunta", need), ("--k", whole))
    command("perguntar", cmd_perguntar, ("--config-exp", {"default": "S3"}), ("--leitor", {"default": "base"} | readers_), ("--pergunta", {}), ("--arquivo", {}), templates)
    command("gerar-perguntas", cmd_gerar_perguntas, ("--n", whole), ("--trechos", {}), ("--saida", {"default": "data/gold_candidatas.jsonl"}), ("--forcar", flag), templates)
    command("exportar-revisao", cmd_exportar_revisao, ("--candidatas", {"default": "data/gold_candidatas.jsonl"}), ("--trechos", {}), ("--saida", {"default": "data/gold_revisao.csv"}), ("--forcar", flag))
    command("importar-revisao", cmd_importar_revisao, ("--csv", need), ("--dividir", flag), ("--reservar-ppl", whole), ("--forcar", flag))
    command("perplexidade", cmd_perplexidade, ("--binario", need), ("--gguf-base", need), ("--gguf-ajustado", need), ("--texto", {}), ("--ctx", whole))
    command("avaliar", cmd_avaliar, ("--gold", need), ("--configs", {"nargs": "+"}), ("--leitores", {"nargs": "+"} | readers_), ("--repeticoes", whole), ("--retomar", {}), ("--limite", whole), ("--perplexidade", {}), ("--alinhamento", flag), templates)
    command("smoke", cmd_smoke, ("--sem-rede", flag), ("--sem-bertscore", flag))
    command("stats", cmd_stats)
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, format="%(levelname)s %(message)s")
    try:
        changes = {k: v for k, v in (("max_tokens", getattr(a, "max_tokens", None)), ("sobreposicao_paragrafos", getattr(a, "sobreposicao_paragrafos", None))) if v is not None}
        c = C.load(a.config, a.sobrescrever, getattr(a, "config_exp", None), {"trechos": changes} if changes else None, name=getattr(a, "config_exp", None))
        return a.run(a, c) or 0
    except UserError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
