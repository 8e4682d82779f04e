"""Configuration, files, and whole jobs with the stand-in client."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillon.errors import UserError
from quillon.operators import models
from quillon.plans import cli, jobs, prompts
from quillon.plans import config as C
from quillon.sources import readers, writers
from quillon.streaming import responses

FRASE = "Não encontrado no manual."


def reader(model, prompt):
    """Quotes the passage that has a number and a word of five letters or more of the question, and names its source."""
    told, _, asked = prompt.rpartition("Pergunta: ")
    wanted = {w.strip("?.,") for w in asked.lower().split() if len(w) > 4}
    for passage in told.split("\n\n"):
        source, _, text = passage.partition(") ")
        if "(seção " in source and wanted & set(text.lower().split()) and any(c.isdigit() for c in text):
            return f"{text.strip().removesuffix('.')} {source[source.index('('):]})."
    return FRASE


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("job")
    pages = [
        ["Manual 1", "1 Introdução", "Este manual fictício descreve as regras do terminal de cargas imaginário."],
        ["Manual 2", "2.1 Atracação", "O navio fictício atraca no berço depois de receber autorização da torre."],
        ["Manual 3", "2.2 Liberação", "A carga fictícia é liberada em até 48 horas após a atracação do navio."],
    ]
    rows = [(1, n, float(k), 0.0, k, 0, t) for n, page in enumerate(pages, 1) for k, t in enumerate(page)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, y0 double, x0 double, block_no int, kind int, text string")
    n_pages = spark.createDataFrame([(1, 3)], "doc_id long, n_pages int")
    paths = {k: str(home / k) for k in ("index_dir", "runs_dir")}
    c = lambda exp: C.load({"paths": paths, "denso": {"dimensao": 64}, "trechos": {"min_tokens": 0}, "modelos": {m: "reader" for m in ("leitor_base", "leitor_ajustado", "embeddings", "gerador")}}, exp)
    make = lambda: models.HashClient(64, reader)
    manifest = jobs.index(spark, blocks, n_pages, c("S3"), make)
    return spark, home, c, make, blocks, manifest


def test_index_is_loaded_only_if_it_fits(made):
    spark, _, c, _, blocks, manifest = made
    assert manifest["n_trechos"] == 3
    assert jobs.Index(spark, c("S3"), blocks).chunks.count() == 3
    changed = C.load({"paths": C.plain(c("S3"))["paths"], "denso": {"dimensao": 64}})
    with pytest.raises(UserError, match="trechos"):
        jobs.Index(spark, changed)
    with pytest.raises(UserError, match="source"):
        jobs.Index(spark, c("S3"), blocks.where("page < 3"))


@pytest.mark.parametrize("exp", ["S0", "S1", "S2", "S3"])
def test_ask(made, exp):
    spark, _, c, make, _, _ = made
    asked = spark.createDataFrame([("q1", "Em quantas horas a carga é liberada após a atracação?", "factual"), ("q2", "Xyz?", None)], "q_id string, text string, kind string")
    index = jobs.Index(spark, c(exp), dense=exp in ("S2", "S3")) if exp != "S0" else None
    r = {x.q_id: x for x in jobs.ask(asked, c(exp), index, make).collect()}
    assert len(r) == 2 and r["q1"].config == exp
    if exp == "S0":
        assert r["q1"].absteve and not r["q1"].recuperadas and not r["q1"].fonte_valida
    else:
        assert "48 horas" in r["q1"].resposta and r["q1"].fonte_valida and r["q1"].citacoes[0].tema_id == "2.2"
        assert [x.rank for x in r["q1"].recuperadas] == list(range(1, len(r["q1"].recuperadas) + 1))


def test_threshold_abstains_without_a_model(made):
    spark, _, c, _, _, _ = made
    limited = C.load({k: v for k, v in C.plain(c("S1")).items() if k != "nome"} | {"abstencao": {"frase": "Não encontrado no manual", "limiar_score": 99.0}})

    def broken():
        raise AssertionError("the model was called")

    asked = spark.createDataFrame([("q1", "Em quantas horas?", "factual")], "q_id string, text string, kind string")
    r = jobs.ask(asked, limited, jobs.Index(spark, limited, dense=False), broken).first()
    assert r.absteve and r.resposta == FRASE and r.t_leitura_s == 0


def test_evaluation_resumes(made):
    spark, home, c, make, _, _ = made
    ids = {r.section_id: r.id for r in spark.read.parquet(str(home / "index_dir/chunks")).collect()}
    items = [
        {"id": "q001", "pergunta": "Em quantas horas a carga é liberada após a atracação?", "resposta_ref": "A carga fictícia é liberada em até 48 horas após a atracação do navio.", "evidencia": [ids["2.2"]], "tipo": "factual", "tema_id": "2.2", "origem": "manual", "revisado": True},
        {"id": "q002", "pergunta": "Qual a cor?", "resposta_ref": FRASE, "evidencia": [], "tipo": "sem_resposta", "tema_id": "1", "origem": "manual", "revisado": True},
    ]
    gold = home / "gold.jsonl"
    gold.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in items) + "\n\n")
    score = lambda p, r, m, n: [1.0] * len(p)
    run, table, gains = jobs.evaluate(spark, str(gold), [c("S0"), c("S1")], ["base", "ajustado"], make, bertscore=score)
    t = {(r.config, r.leitor): r for r in table.collect()}
    assert len(t) == 4 and t["S1", "base"].em == 1 and t["S1", "base"].recall_at_5 == 1 and t["S0", "base"].abst_indevida == 1 and t["S0", "base"].recall_at_5 is None
    assert t["S1", "base"].bertscore_f1 == 1 and t["S1", "base"].abst_correta == 1 and gains.count() == 4
    before = spark.read.json(f"{run}/respostas").count()
    jobs.evaluate(spark, str(gold), [c("S0"), c("S1")], ["base", "ajustado"], make, resume=run.rsplit("/", 1)[1])
    assert before == spark.read.json(f"{run}/respostas").count() == 8
    with pytest.raises(UserError, match="repeticoes"):
        jobs.evaluate(spark, str(gold), [c("S0"), c("S1")], ["base", "ajustado"], make, repeats=2, resume=run.rsplit("/", 1)[1])
    with open(f"{run}/log.txt") as f:
        assert "horas" not in f.read()


def test_candidates_and_review_round_trip(made):
    spark, home, c, _, _, _ = made
    make = lambda: models.HashClient(64, lambda m, p: '{"pergunta": "Qual o prazo?", "resposta": "48; \\"horas\\"\\ndois"}')
    chunks = spark.read.parquet(str(home / "index_dir/chunks")).withColumn("n_tokens", F.lit(200))
    cands, stats = jobs.candidates(chunks, c("S3"), make, 5)
    rows = cands.collect()
    assert [r.id for r in rows] == ["q001", "q002", "q003", "q004"] and {r.tipo for r in rows} >= {"factual", "sem_resposta"} and stats.first().valid_share == 1
    from quillon.operators import gold

    cands = spark.createDataFrame(rows, cands.schema)
    review = gold.review_table(cands, chunks).withColumn("decisao", F.lit("aceitar"))
    writers.write_review(review, str(home / "review"))
    name = next((home / "review").glob("*.csv"))
    assert name.read_bytes().startswith("﻿id;".encode())
    back = gold.imported(readers.read_review(spark, str(name)), "nada").orderBy("id").collect()
    assert [r.id for r in back] == ["q001", "q002", "q003", "q004"]
    assert {r.resposta_ref for r in back} == {'48; "horas"\ndois', "nada"}


def test_readers(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# c\n\n a? \nb?\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.txt")).collect()] == [("u001", "a?"), ("u002", "b?")]
    (tmp_path / "e.txt").write_text("#\n")
    with pytest.raises(UserError):
        readers.read_questions(spark, str(tmp_path / "e.txt"))
    (tmp_path / "lines.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n{broken\n')
    with pytest.raises(UserError, match="lines.jsonl, line 4: broken"):
        readers.read_jsonl(spark, str(tmp_path / "lines.jsonl"), "id string", ("id",))
    for n, text in enumerate(('{"id": "a"}\n{broken\n', '["a"]\n', '{"id": null}\n', '{"x": 1}\n')):
        f = tmp_path / f"{n}.jsonl"
        f.write_text(text)
        with pytest.raises(UserError):
            readers.read_jsonl(spark, str(f), "id string", ("id",))
    assert readers.delimiter("a;b,c") == ";" and readers.delimiter("a,b,c;d") == "," and readers.delimiter("a\tb\tc") == "\t"
    with pytest.raises(UserError):
        readers.require_file(str(tmp_path / "q.txt"), (".csv",))
    with pytest.raises(UserError):
        readers.require_file(str(tmp_path / "none"))
    (tmp_path / "r.csv").write_text("id;tipo\nq;x\n")
    with pytest.raises(UserError, match="missing columns"):
        readers.read_review(spark, str(tmp_path / "r.csv"))


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.delenv("OLLAMA_HOST", raising=False)
    assert C.load("S1")["retriever"] == "bm25" and C.load("S1")["nome"] == "S1" and C.load({"rrf_c": 1, "denso": {"dimensao": 2}})["denso"]["batch_size"] == 16
    for bad in ({"nope": 1}, {"k": 0}, {"k": True}, {"k": 1.0}, {"bm25": {"k1": "x"}}, {"retriever": "x"}, {"bm25": 3}, {"trechos": {"min_tokens": 500}}, {"ingestao": {"regex_titulo": "("}}):
        with pytest.raises(UserError):
            C.load(bad)
    assert C.load({"bm25": {"k1": 2}})["bm25"]["k1"] == 2.0 and C.load({"abstencao": {"limiar_score": 1}})["abstencao"]["limiar_score"] == 1.0
    with pytest.raises(UserError, match="k must.*rrf_c"):
        C.load({"k": 0, "rrf_c": -1})
    (tmp_path / "c.yaml").write_text("k: 7\n")
    assert C.load(str(tmp_path / "c.yaml"))["k"] == 7
    monkeypatch.setenv("OLLAMA_HOST", "127.0.0.1:1")
    assert C.load()["ollama"]["host"] == "http://127.0.0.1:1"
    with pytest.raises(UserError):
        C.reader_model(C.load(), "other")


def test_every_key_is_held_against_the_table():
    from types import MappingProxyType

    assert [C.within(i, x) for i, x in (("(0, 1]", 0), ("(0, 1]", 1), ("[0, 1)", 0), ("[0, 1)", 1), ("[1, inf)", 1), ("[1, inf)", 10**9))] == [False, True, True, False, True, True]
    c = C.load()
    for name, (kind, default, *allowed) in C.KEYS.items():
        section, _, key = name.rpartition(".")
        assert (c[section] if section else c)[key] == default
        wrong = {C.FLAG: 1, C.WHOLE: 1.5, C.NUMBER: "1", C.LIST: [1], C.MAYBE: "x"}.get(kind, 3)
        bad = [wrong] + ([float(allowed[0][1:-1].split(",")[0]) - 1] if allowed and isinstance(allowed[0], str) and kind is C.NUMBER else [])
        for value in bad:
            with pytest.raises(UserError, match=re.escape(name)):
                C.load({section: {key: value}} if section else {key: value})
    assert isinstance(c["gold"], MappingProxyType) and C.plain(c)["avaliacao"]["leitores"] == ["base", "ajustado"]
    with pytest.raises(UserError, match="unknown key gold.x; unknown key nope"):
        C.load({"gold": {"x": 1}, "nope": 1})
    with pytest.raises(UserError, match="gold must be a section"):
        C.load({"gold": 1})
    with pytest.raises(UserError, match="k must not be above k_candidatos_por_lista"):
        C.load({"k": 50})
    assert C.load({"gold": {}}, None, "S2", name="own")["nome"] == "own" and C.load({}, "S2")["nome"] == "S2"


def test_command_line(spark, made, tmp_path, capsys, monkeypatch):
    _, home, c, _, blocks, _ = made
    monkeypatch.chdir(tmp_path)
    blocks.write.parquet(str(tmp_path / "blocks.parquet"))
    import yaml

    names = {m: "reader" for m in ("leitor_base", "leitor_ajustado", "embeddings", "gerador")}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"paths": {"index_dir": str(tmp_path / "i"), "runs_dir": str(tmp_path / "r")}, "denso": {"dimensao": 64}, "trechos": {"min_tokens": 0}, "modelos": names, "ollama": {"host": "http://hash"}}))
    base = ["--config", "c.yaml"]
    assert cli.main(["indexar", "--manual", str(tmp_path / "blocks.parquet"), *base]) == 0
    for mode in ("bm25", "denso", "hibrido"):
        assert cli.main(["recuperar", "--modo", mode, "--pergunta", "carga liberada horas", "--k", "2", *base]) == 0
    assert "t0003" in capsys.readouterr().out
    assert cli.main(["perguntar", "--config-exp", "S1", "--pergunta", "carga?", *base]) == 0
    assert cli.main(["perguntar", *base]) == 2 and cli.main(["perguntar", "--pergunta", "a", "--arquivo", "b", *base]) == 2
    assert cli.main(["stats", *base]) == 0 and cli.main(["smoke", "--sem-bertscore", "-v", *base]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert cli.main(["stats", "--config", "none.yaml"]) == 2
    assert cli.main(["recuperar", "--modo", "bm25", "--pergunta", "x", "--k", "0", *base]) == 2
    monkeypatch.setenv("OLLAMA_HOST", "http://example.com")
    assert cli.main(["indexar", "--manual", str(tmp_path / "blocks.parquet"), *base]) == 2


def test_stream_stores_each_key_once(spark, tmp_path):
    schema = "config string, leitor string, q_id string, repeticao int, ts timestamp, latencia_s double"
    (tmp_path / "in").mkdir()

    def drop(n, ids):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"config": "S1", "leitor": "base", "q_id": i, "repeticao": 1, "ts": f"2024-01-01T00:{n:02d}:00Z", "latencia_s": 1.0}) + "\n" for i in ids))
        q = responses.store_once(responses.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()

    drop(1, ["a", "b", "a"])
    drop(2, ["b", "c"])
    assert sorted(r.q_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_stream_latency(spark, tmp_path):
    schema = "config string, leitor string, q_id string, repeticao int, ts timestamp, latencia_s double"
    rows = [("S1", "00:01", 1.0), ("S1", "00:02", 3.0), ("S1", "00:40", 5.0)]
    (tmp_path / "a.json").write_text("".join(json.dumps({"config": c, "ts": f"2024-01-01T{t}:00Z", "latencia_s": v}) + "\n" for c, t, v in rows))
    q = responses.running_latency(responses.read(spark, str(tmp_path), schema)).writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.mean_s, r.max_s) for r in spark.sql("select * from latency").collect()) == [(1, 5.0, 5.0), (2, 2.0, 3.0)]


def test_synced_folders():
    assert jobs.synced_folder("/home/x/Dropbox/y") == "Dropbox" and jobs.synced_folder("/data/y") is None


def test_templates(tmp_path):
    assert all(prompts.checked(n, t) == t for n, t in prompts.DEFAULTS.items())
    (tmp_path / "reader_alone.txt").write_text("{{P}}: {pergunta}", encoding="utf-8")
    assert prompts.load(str(tmp_path))["reader_alone"] == "{{P}}: {pergunta}" and prompts.load(str(tmp_path))["reader"] == prompts.DEFAULTS["reader"]
    for wrong in ("no field", "{pergunta} {other}", "{pergunta"):
        (tmp_path / "reader_alone.txt").write_text(wrong)
        with pytest.raises(UserError):
            prompts.load(str(tmp_path))
    with pytest.raises(UserError):
        prompts.load(str(tmp_path / "none"))


def test_recall_bars_and_markdown(spark):
    t = spark.createDataFrame([("S1", "base", 0.5, 0.25), ("S0", "base", None, None)], "config string, leitor string, recall_at_5 double, mrr_at_5 double")
    assert sorted(map(tuple, writers.recall_plot_data(t).collect())) == [("S1", "base", "mrr_at_5", 0.25), ("S1", "base", "recall_at_5", 0.5)]
    assert writers.markdown(t.limit(1)).splitlines()[2] == "| S1 | base | 0.5 | 0.25 |"
