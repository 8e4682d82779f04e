"""Operators on small tables with known results."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.errors import ModelError, UserError
from quillon.operators import chunking, gold, ingest, metrics, models, perplexity, select
from quillon.operators import retrieval as R


def blocks(spark, pages):
    """pages: lists of texts, from top to bottom."""
    rows = [(1, n, float(k), 0.0, k, 0, t) for n, page in enumerate(pages, 1) for k, t in enumerate(page)]
    return spark.createDataFrame(rows, "doc_id long, page int, y0 double, x0 double, block_no int, kind int, text string"), spark.createDataFrame([(1, len(pages))], "doc_id long, n_pages int")


def test_reading_order(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 9.0, 0, 0, "c"), (1, 1, 5.04, 1.0, 1, 0, "b"), (1, 1, 1.0, 0.0, 2, 0, "a"), (1, 1, 0.0, 0.0, 3, 1, "image"), (1, 1, 0.0, 0.0, 4, 0, "  ")], "doc_id long, page int, y0 double, x0 double, block_no int, kind int, text string")
    assert [r.text for r in ingest.text_blocks(df).orderBy("block_idx").collect()] == ["a", "b", "c"]


def test_scanned_document_is_refused(spark):
    b, n = blocks(spark, [["x" * 60], ["short"], [], [], [], []])
    layer = ingest.text_layer(ingest.text_blocks(b), n)
    assert layer.first().empty_pages == 5
    with pytest.raises(UserError, match="OCR"):
        ingest.require_readable(layer)


def test_repeated_keys(spark):
    b, n = blocks(spark, [["Cabeçalho 1", "texto único"], ["Cabeçalho 2", "17"], ["Cabeçalho 3"]])
    assert [r.key for r in ingest.repeated_keys(ingest.text_blocks(b), n, 0.5).collect()] == ["Cabeçalho"]


LONG = "Uma frase de exemplo com mais de oitenta letras, para que nunca seja parte de um título em duas linhas."


def test_paragraphs_know_their_section(spark):
    b, n = blocks(
        spark,
        [
            ["Porto 1", LONG + " Antes.", "3 Emergências\n" + LONG, "1 Acionar o alarme mais próximo do local.", "curto"],
            ["Porto 2", "2 Comunicar a central de segurança.\n\n" + LONG, "4 Manutenção dos\nequipamentos", LONG + "\n\n4.1 Índice ...... 7"],
        ],
    )
    rows, counts = ingest.paragraphs(ingest.text_blocks(b), n)
    found = [(r.section_id, r.is_title, r.text[:12], r.page) for r in rows.orderBy("idx").collect()]
    assert found == [
        ("", False, "Uma frase de", 1),
        ("3", True, "3 Emergência", 1),
        ("3", False, "Uma frase de", 1),
        ("3", False, "1 Acionar o ", 1),
        ("3", False, "2 Comunicar ", 2),
        ("3", False, "Uma frase de", 2),
        ("4", True, "4 Manutenção", 2),
        ("4", False, "Uma frase de", 2),
    ]
    assert rows.where("section_id = ''").first().section == ingest.NO_SECTION
    c = counts.first()
    assert (c.n_titles, c.n_paragraphs, c.short_dropped, c.titles_out_of_order) == (2, 6, 1, 2)


def paragraphs(spark, sizes):
    """(section, words) with None for a title."""
    rows = [(1, i, 1 + i // 5, f"{s} X", s, "w " * (n or 1), n is None) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, idx int, page int, section string, section_id string, text string, is_title boolean")


def test_chunk_rules(spark):
    p = paragraphs(spark, [("1", None), ("1", 10), ("1", 95), ("1", 50), ("1", 10), ("2", None), ("2", 150)])
    t = chunking.chunks(p, 100, 30, 1.0).orderBy("id").collect()
    assert [(r.id, r.n_paragraphs, r.n_tokens, r.section_id) for r in t] == [("t0001", 2, 105, "1"), ("t0002", 2, 60, "1"), ("t0003", 1, 150, "2")]


def test_chunk_overlap(spark):
    p = paragraphs(spark, [("1", None), ("1", 40), ("1", 41), ("1", 42)])
    t = chunking.chunks(p, 60, 1, 1.0, overlap=1).orderBy("id").collect()
    assert [r.n_paragraphs for r in t] == [1, 2, 2] and [r.n_tokens for r in t] == [40, 81, 83]


def test_words_of_a_paragraph_are_counted_once(spark, monkeypatch):
    seen, words = [], chunking.T.words
    monkeypatch.setattr(chunking.T, "words", lambda text: seen.append(text) or words(text))
    rows = [(1, i, 1, "s", "1", t, False) for i, t in enumerate(["um dois", " três\u2003quatro ", "", "cinco\nseis\x85sete", "oito"])]
    made = chunking.chunks(spark.createDataFrame(rows, "doc_id long, idx int, page int, section string, section_id string, text string, is_title boolean"), 4, 2, 1.0, 1)
    found = [(r.text, r.n_tokens) for r in made.orderBy("id").collect()]
    assert len(seen) == 1 and len(found) > 1
    assert [n for _, n in found] == [max(1, len(t.split())) for t, _ in found]


def test_same_number_under_a_new_title_is_a_new_segment(spark):
    p = paragraphs(spark, [("1", 5), ("1", None), ("1", 5)])
    assert chunking.chunks(p, 100, 0, 1.0).count() == 2


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([("a", 5), ("", 95), ("a", 100)], "section_id string, n_tokens int")
    h = [(r.bin_lo, r.bin_hi, r.n) for r in chunking.histogram(df).orderBy("bin_lo").collect()]
    assert len(h) == 10 and h[0] == (0, 9, 1) and h[9] == (90, 99, 2)
    s = chunking.statistics(df).first()
    assert (s.n_chunks, s.n_sections, s.mean_tokens, s.median_tokens, s.below_min) == (3, 2, 66.7, 95, 1)


def ranked(spark, ids, q=1):
    return spark.createDataFrame([(q, i, k) for k, i in enumerate(ids, 1)], "q_id long, id string, rank int")


def test_fusion(spark):
    t = R.fused([ranked(spark, "abc"), ranked(spark, "bcd")], 60, 3).orderBy("rank").collect()
    assert [r.id for r in t] == ["b", "c", "a"] and t[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    assert [r.id for r in R.fused([ranked(spark, "ba"), ranked(spark, "ab")], 60, 2).orderBy("rank").collect()] == ["a", "b"]


def test_lexical_search_counts_empty_texts(spark, tmp_path):
    docs = spark.createDataFrame([("t1", "navio no porto"), ("t2", ""), ("t3", "carga carga do navio"), ("t4", None)], "id string, text string")
    index = R.LexicalIndex.build(docs)
    totals = index.totals.first()
    assert (totals.n, totals.avgdl) == (4, (3 + 1 + 4 + 1) / 4)
    asked = spark.createDataFrame([(1, "carga"), (2, "!!"), (3, "carga navio carga")], "q_id long, text string")
    t = index.search(asked, 5)
    assert [(r.q_id, r.id) for r in t.orderBy("q_id", "rank").collect()] == [(1, "t3"), (3, "t3"), (3, "t1")]
    idf, w = np.log(1 + 3.5 / 1.5), 2 / (2 + 1.5 * (0.25 + 0.75 * 4 / 2.25))
    assert t.where("q_id = 1").first().score == pytest.approx(idf * w, abs=1e-6)
    index.save(str(tmp_path))
    assert R.LexicalIndex.load(spark, str(tmp_path)).search(asked, 5).count() == 3


def counted_texts(spark, df):
    """The table, and how often one of its texts was looked at."""
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    return df.withColumn("text", F.udf(look, "string").asNondeterministic()("text")), seen


def test_index_for_known_questions_is_that_of_all_and_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "pressão do pneu pneu"), (2, ""), (2, "pneu"), (3, None), (4, "óleo e pneu novo"), (5, "outro texto")], "id long, text string")
    asked = spark.createDataFrame([(1, "pneu óleo"), (2, "texto texto zzz")], "q_id long, text string")
    texts, seen = counted_texts(spark, docs)
    few = R.LexicalIndex.build(texts, only_terms=R.question_terms(asked).select("term").distinct())
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = R.LexicalIndex.build(docs)
    for k1 in (1.5, 0.9):
        assert rows(few.search(asked, 3, k1=k1)) == rows(whole.search(asked, 3, k1=k1))
    assert rows(few.totals) == rows(whole.totals)
    assert {t[0] for t in rows(few.terms)} == {"pneu", "óleo", "texto"}
    assert seen.value == docs.count()
    none = R.LexicalIndex.build(docs.where("false"), only_terms=R.question_terms(asked).select("term").distinct())
    assert none.search(asked, 3).count() == 0 and rows(none.totals) == [(0, None)]


@pytest.mark.parametrize("products", [R.PRODUCTS, 20])
def test_searches_of_few_terms_are_those_of_the_whole_index(spark, monkeypatch, products):
    monkeypatch.setattr(R, "PRODUCTS", products)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(40)]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts)) for _ in range(300)]  # repeated ids, of equal and of other lengths
    docs = spark.createDataFrame([*docs, *((k, "w1 w2") for k in range(100, 120))], "id long, text string").repartition(5)
    asked = spark.createDataFrame([*((f"q{k}", " ".join(draw.choices(words[:12], k=4))) for k in range(9)), (None, "w1 w1 w9"), ("z", "zzz")], "q_id string, text string")
    few = R.LexicalIndex.build(docs, only_terms=R.question_terms(asked).select("term").distinct())
    whole = R.LexicalIndex.build(docs)
    weights = ((1.5, 0.75), (0.9, 0.4))
    rows = lambda df: sorted(((r.q_id or "", r.rank, r.id, r.score) for r in df.collect()), key=str)
    found = few.searches(asked, 6, weights).persist()
    for run, (k1, b) in enumerate(weights):
        wanted = rows(whole.search(asked, 6, k1=k1, b=b))
        assert rows(found.where(f"run = {run}")) == wanted and len(wanted) == 60
        assert rows(few.search(asked, 6, k1=k1, b=b)) == wanted
    assert sorted(map(str, few.postings.collect())) == sorted(map(str, whole.postings.join(few.terms.select("term"), "term").select("id", "term", "dl", "tf").collect()))
    assert sorted(map(str, few.terms.collect())) == sorted(map(str, whole.terms.join(few.terms.select("term"), "term").collect()))


def test_nearest_is_exact_for_any_blocks(spark):
    draw = np.random.default_rng(0)
    v = draw.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    q = df.where("id < 40").withColumnRenamed("id", "q_id")
    for sizes in ((2048, 8192), (7, 50)):
        found = {}
        for r in R.nearest(q, df, 4, *sizes).collect():
            found.setdefault(r.q_id, []).append((r.rank, r.id))
        s = np.round(v[:40].astype(float) @ v.T.astype(float), 6)
        for i in range(40):
            assert [x for _, x in sorted(found[i])] == np.argsort(-s[i], kind="stable")[:4].tolist()
    assert R.nearest(q.where("false"), df, 4).count() == 0


def test_retrieve_modes(spark):
    asked = spark.createDataFrame([(1, "x")], "q_id long, text string")
    assert R.retrieve("none", asked).count() == 0
    for bad in ("lexical", "dense", "other"):
        with pytest.raises(UserError):
            R.retrieve(bad, asked)
    with pytest.raises(UserError):
        R.retrieve("none", asked, k=0)


def test_anchor_evidence_finds_parts_of_words(spark):
    a = spark.createDataFrame([(1, "vio  entrou no POR"), (2, "nada disso aqui"), (3, "car"), (4, " ")], "q_id long, anchor string")
    c = spark.createDataFrame([("t1", "o navio entrou\nno porto"), ("t2", "carga no porto")], "id string, text string")
    assert {(r.q_id, r.id, r.n_chunks) for r in R.anchor_evidence(a, c).collect()} == {(1, "t1", 1), (3, "t2", 1)}


def test_anchors_in_parts_are_found_in_one_scan_each(spark):
    import random

    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 3)))
    anchors = sorted({" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(300)})
    texts = [(i, " ".join(word() for _ in range(draw.randint(0, 30)))) for i in range(120)] + [(500, ""), (501, None), (7, "a repeated id")]
    a = spark.createDataFrame([(x,) for x in anchors], "anchor string")
    assert len(R.anchor_shards(a, 100)) > 5
    found = R.holders(a, spark.createDataFrame(texts, "id int, text string"), 100)
    assert sorted((r.anchor, r.id) for r in found.collect()) == sorted((x, i) for x in anchors for i, t in texts if t and x in t)
    assert "Exchange" not in R.holders(a, spark.createDataFrame(texts, "id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert R.holders(a.limit(0), spark.createDataFrame(texts, "id int, text string")).collect() == []
    many = spark.range(100_000).selectExpr("concat('key ', id, ' of many') as anchor")
    some = spark.createDataFrame([(1, "x key 77 of many y key 99999 of many key 100000 of many")], "id int, text string")
    assert {r.anchor for r in R.holders(many, some).collect()} == {"key 77 of many", "key 99999 of many"}


def test_anchor_evidence_of_any_length_is_that_of_brute_force(spark):
    texts = [("t1", "a casa azul"), ("t2", "casas  azuis"), ("t3", "descasado AZULEJO"), ("t4", None), ("t5", ""), ("t6", "😀éa" + "b" * 50_000 + " fim"), ("t7", "incomunicabilidade e comunicabilidades")]
    anchors = ["casa", "casa azul", "a", "s az", "bbb", "b f", "😀", "éa", "comunicabilidade", "comunicabilidade e", "a casa azul", "ca azul", "zz", " ", None, "b" * 50_000]
    a = spark.createDataFrame(list(enumerate(anchors)), "q_id long, anchor string")
    found = R.anchor_evidence(a, spark.createDataFrame(texts, "id string, text string"))
    flat = lambda x: " ".join((x or "").lower().split())
    wanted = [(q, i) for q, x in enumerate(anchors) for i, t in texts if flat(x) and flat(x) in flat(t)]
    assert sorted((r.q_id, r.id) for r in found.collect()) == sorted(wanted)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_one_reading_gives_index_sizes_and_evidence(spark, monkeypatch):
    odd = "The  Casa_azul, l'été — “ÉTÉ” e\u0301te\u0301 ΑΣ ΑΣ. İx ①² x 😀y10 a\u00a0b\u2028c, und\x1cso\x85fort DE d\u200be \u3000"
    docs = [(1, odd), (2, None), (2, ""), (3, " \t"), (4, "a casa"), (4, "A  CASA azul"), (None, "uma casa azul aqui"), (None, odd), (5, "~" * 9 + "azul" * 3), (6, "casa " * 50_000)]
    docs += [(10 + i, f"azul x{i} casa" if i % 3 else odd[i % len(odd) :]) for i in range(60)]
    asked = [(1, "Casa  azul"), (2, "azul"), (3, "été ÉTÉ und so"), (4, " "), (5, None), (6, "ΑΣ"), (7, "casa azul"), (8, "de und"), (9, "i̇x ①²")]
    table, questions = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "q_id long, text string")
    flat = {(r.q_id, r.anchor) for r in R.flat_anchors(questions.withColumnRenamed("text", "anchor")).collect()}
    low = [(r.id, " ".join((r.t or "").split()), len((r.t or "").split())) for r in table.selectExpr("id", "lower(text) as t").collect()]
    order = lambda rows: sorted(rows, key=repr)
    for size, sent, chars, accents in ((1 << 23, 100_000, 1 << 20, True), (100, 100_000, 1 << 20, False), (100, 3, 1 << 20, True), (100, 100_000, 5, True)):
        for name, value in (("SLICE", size), ("SENT_TERMS", sent), ("SHARD_CHARS", chars)):
            monkeypatch.setattr(R, name, value)
        texts, seen = counted_texts(spark, table)
        index, sizes, evidence = R.surveyed(texts, questions, stop_words=("und", "été"), keep_accents=accents)
        assert order(tuple(r) for r in sizes.collect()) == order((i, n) for i, _, n in low)
        assert order(tuple(r) for r in evidence.select("q_id", "id").collect()) == order((q, i) for q, a in flat for i, t, _ in low if a in t)
        whole = R.LexicalIndex.build(table, stop_words=("und", "été"), keep_accents=accents)
        assert tuple(index.totals.first()) == tuple(whole.totals.first())
        wanted = whole.search(questions, 4, stop_words=("und", "été"), keep_accents=accents)
        assert set(index.search(questions, 4, stop_words=("und", "été"), keep_accents=accents).select(*wanted.columns).collect()) == set(wanted.collect()) != set()
        assert seen.value == len(docs) or sent == 3 or chars == 5
    assert R.surveyed(table, questions.limit(0))[2].collect() == []


def test_split_plain_gives_the_tokens_of_every_character(spark):
    import pyarrow as pa

    from quillon.functions import text as T

    c = spark.createDataFrame(pa.table({"text": [f"ab{chr(i)}cd" for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]})).repartition(8)
    rows = c.select(T.spaced(F.col("text")).alias("s"), F.array_join(T.tokens(F.col("text")), " ").alias("t")).toArrow()
    pieces = R.split_plain(rows["s"].combine_chunks().slice(7)).to_pylist()
    assert [" ".join(w for w in p if len(w) > 1) for p in pieces] == rows["t"].slice(7).to_pylist()
    assert R.split_plain(pa.array([], pa.string())).to_pylist() == [] and R.split_plain(pa.array(["", "a"])).to_pylist() == [[""], ["a"]]


def test_distractors_query_reads_each_document_once(spark, sf_dir, monkeypatch):
    from quillon.queries import search

    plain, seen = search.table, []

    def table(spark, sf_dir, name):
        df = plain(spark, sf_dir, name)
        if name != "documents":
            return df
        df, n = counted_texts(spark, df)
        seen.append(n)
        return df

    monkeypatch.setattr(search, "table", table)
    assert search.distractors(spark, sf_dir).collect()
    assert sum(n.value for n in seen) == plain(spark, sf_dir, "documents").count()


def test_distractors_pass_over_what_does_not_fit(spark):
    chunks = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate([100, 900, 50, 60, 70])], "id string, n_tokens int")
    evidence = spark.createDataFrame([(1, "t0")], "q_id long, id string")
    t = R.distractors(ranked(spark, ["t0", "t1", "t2"]), evidence, chunks, 2, 220).orderBy("place").collect()
    assert t[0].id == "t2" and len(t) == 2 and t[1].id in ("t3", "t4")


def test_distractors_are_those_of_brute_force(spark):
    import hashlib
    import random

    draw = random.Random(5)
    sizes = {f"t{i}": draw.choice([draw.randint(1, 40), draw.randint(100, 900)]) if i % 9 == 0 else draw.randint(300, 900) for i in range(600)}
    evidence, hits = {}, {}
    for q in range(60):
        evidence[q] = draw.sample(sorted(sizes), draw.randint(1, 4))
        hits[q] = [] if q % 7 == 0 else draw.sample(sorted(sizes), 6)
    hits[1][0] = evidence[1][0]
    order = sorted(sizes, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    wanted, short = {}, 0
    for q in range(60):
        used, out = sum(sizes[i] for i in evidence[q]), []
        for i in hits[q] + [i for i in order if i not in hits[q]]:
            if i not in evidence[q] and len(out) < 3 and used + sizes[i] <= 1000:
                out.append(i)
                used += sizes[i]
                short += i not in hits[q] and order.index(i) >= 60
        if out:
            wanted[q] = out
    assert short  # so some lie beyond the first documents
    chunks = spark.createDataFrame(list(sizes.items()), "id string, n_tokens int").repartition(5)
    asked = spark.createDataFrame([(q, i, k) for q, x in hits.items() for k, i in enumerate(x, 1)], "q_id long, id string, rank int")
    gold_ = spark.createDataFrame([(q, i) for q, x in evidence.items() for i in x], "q_id long, id string")
    got = {}
    for r in R.distractors(asked, gold_, chunks, 3, 1000).orderBy("q_id", "place").collect():
        got.setdefault(r.q_id, []).append(r.id)
    assert got == wanted


def test_training_set(spark):
    rows = [(k, 39 if k == 0 else 100 + k, str(k), "", k, f"words of chunk{k}.") for k in range(31)]
    chunks = spark.createDataFrame(rows, "id long, n_tokens int, section_id string, section string, page_start int, text string")
    tasks = gold.training_tasks(chunks)
    replies = tasks.selectExpr("place", "0 as attempt", """concat('{"pergunta": "what is chunk', id, '?", "resposta": "It is ', id, ' (seção 99, p. 7)."}') as reply""")
    search = lambda q: R.LexicalIndex.build(chunks).search(q, 7)
    out = {r.id: r for r in gold.training_set(tasks, replies, chunks, search, "<{contexto}> {pergunta}", "Nada").collect()}
    kinds = {r.id: r.kind for r in tasks.collect()}
    assert set(out) == set(range(1, 31)) and sum(k == "sem_resposta" for k in kinds.values()) == 6
    for i, r in out.items():
        assert r.answer == ("Nada." if kinds[i] == "sem_resposta" else f"It is {i} (seção {i}, p. {i})")
        assert r.prompt.endswith(f"> what is chunk{i}?") and f"words of chunk{i}." in r.prompt
        assert r.n_chunks == r.prompt.count("words of") and 3 <= r.n_chunks <= 5
    assert {r.n_chunks for r in out.values()} == {3, 4, 5}
    assert len({r.prompt.index(f"words of chunk{i}.") > 30 for i, r in out.items()}) == 2  # the chunk isn't always first
    assert sum(r.part == "validation" for r in out.values()) == 2


def test_training_tasks_are_sampled_once(spark):
    texts, seen = counted_texts(spark, spark.createDataFrame([(k, 50, "s", f"texto {k}") for k in range(20)], "id long, n_tokens int, section_id string, text string"))
    tasks = gold.training_tasks(texts.where(F.length("text") > 0), 5)
    assert tasks.count() == 5 and tasks.where("kind = 'sem_resposta'").count() == 1
    assert seen.value == 20


def test_least_keys_are_those_of_sorting(spark, monkeypatch):
    import random

    draw = random.Random(5)
    keys = [f"{draw.randrange(16**6):06x}" for _ in range(3000)] + ["0000aa"] * 7 + ["ffffff"] * 3
    rows = spark.createDataFrame([(k,) for k in keys], "k string").persist()
    keys.sort()
    for step in (1, 3, 4):
        monkeypatch.setattr(select, "STEP", step)
        for k in (0, 1, 7, 8, 1500, 3007, 3009, 3010, 5000):
            found = sorted(r.k for r in rows.where(select.least_keys(rows, F.col("k"), 6, k)).collect())
            assert found == [x for x in keys if k and x <= keys[min(k, len(keys)) - 1]], (step, k)


def test_quotas_over_a_million_groups(spark):
    n = 1_000_000
    counts = spark.range(n).select(F.col("id").alias("grp"), (1 + F.col("id") % 3).alias("size"))
    q = gold.quotas(counts, 1_300_000)
    assert "Window" not in q._jdf.queryExecution().executedPlan().toString()
    found = q.agg(F.sum("quota"), F.min("quota"), F.count_if(F.col("quota") > F.col("size")), F.count("*")).first()
    assert tuple(found) == (1_300_000, 1, 0, n)
    assert q.where("size = 1").agg(F.max("quota")).first()[0] == 1


def test_quotas_by_largest_remainder(spark):
    counts = lambda d: spark.createDataFrame(list(d.items()), "grp string, size long")
    q = lambda d, n: {r.grp: r.quota for r in gold.quotas(counts(d), n).collect()}
    assert set(q({c: 4 for c in "abcdef"}, 12).values()) == {2}
    assert sum(q({"a": 50, "b": 3, "c": 1}, 20).values()) == 20 and q({"a": 50, "b": 3, "c": 1}, 20)["c"] == 1
    assert q({"a": 2, "b": 1}, 10) == {"a": 2, "b": 1}
    assert sum(q({c: 9 for c in "abcdef"}, 4).values()) == 4


REVIEW = "id string, tipo string, tema_id string, evidencia string, pergunta string, resposta_ref string, decisao string, pergunta_corrigida string, resposta_corrigida string, line int"


def test_review(spark):
    rows = [
        ("q1", "factual", "1", "t0001|t0002", " p ", "r", "Aceitar", None, None, 2),
        ("q2", "sem_resposta", "1", "t0009", "p", "r", "editar", "novo", None, 3),
        ("q3", "factual", "1", "t3", "p", "r", "descartar", None, None, 4),
    ]
    kept = gold.imported(spark.createDataFrame(rows, REVIEW), "nada").orderBy("id").collect()
    assert [(r.id, r.pergunta, r.resposta_ref, r.evidencia, r.origem) for r in kept] == [("q1", "p", "r", ["t0001", "t0002"], "gerado"), ("q2", "novo", "nada", [], "editado")]
    bad = [("q1", "x", "", "t1", "p", "r", "aceitar", None, None, 5), ("q1", "factual", "", "t1", "p", "r", "aceitar", None, None, 6), ("q5", "factual", "", "", "p", "r", "aceitar", None, None, 7), ("q6", "factual", "", "t1", "p", "r", "editar", " ", None, 8), ("q7", "factual", "", "t1", "p", "r", "", None, None, 9), ("q8", "factual", "", "t1", "p", "r", "talvez", None, None, 10)]
    errors = {r.line: r.error for r in gold.reviewed(spark.createDataFrame(bad, REVIEW), "nada").collect()}
    assert errors == {5: "unknown kind", 6: "repeated id", 7: "no evidence", 8: "edit without a change", 9: "no decision", 10: "unknown decision"}
    with pytest.raises(UserError, match="line 5"):
        gold.imported(spark.createDataFrame(rows + bad, REVIEW), "nada")


def test_split_keeps_groups_together(spark):
    rows = [(f"q{i:02d}", f"s{i % 6}", "sem_resposta" if i % 5 == 0 else "factual") for i in range(60)]
    t = gold.split(spark.createDataFrame(rows, "id string, tema_id string, tipo string")).collect()
    sides = {}
    for r in t:
        sides.setdefault(r.tema_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and {r.split for r in t} == {"dev", "test"}
    assert {r.split for r in t if r.tipo == "sem_resposta"} == {"dev", "test"} and len(t) == 60
    one = [("q1", "a", "factual"), ("q2", "a", "sem_resposta"), ("q3", "b", "factual"), ("q4", "a", "sem_resposta")]
    t = gold.split(spark.createDataFrame(one, "id string, tema_id string, tipo string")).collect()
    assert {r.split for r in t if r.tipo == "sem_resposta"} == {"dev", "test"} and len(t) == 4
    with pytest.raises(UserError):
        gold.split(spark.createDataFrame(one[:2], "id string, tema_id string, tipo string"))


SCORED = "config string, leitor string, q_id string, answerable boolean, absteve boolean, fonte_valida boolean, latencia_s double, em int, f1_tokens double, bertscore_f1 double, recall int, mrr double"


def test_equal_texts_match_without_their_normal_forms(spark, monkeypatch):
    df = spark.createDataFrame([("a b", "a b"), (None, "a"), ("a", None), ("", "")], "p string, r string")
    found = lambda: [x.em for x in df.select(metrics.exact_match(F.col("p"), F.col("r")).alias("em")).collect()]
    assert found() == [1, None, None, 1]
    df = df.where("p = r")
    monkeypatch.setattr(metrics.T, "answer_text", lambda text: F.raise_error(F.concat(text, F.lit(" is made normal"))))
    assert found() == [1, 1]


def test_aggregation_takes_each_mean_over_its_own_rows(spark):
    rows = [("S3", "base", "q1", True, False, True, 1.0, 1, 1.0, 0.9, 1, 0.5), ("S3", "base", "q2", True, True, False, 2.0, 0, 0.0, 0.0, 0, 0.0), ("S3", "base", "q3", False, False, False, 3.0, None, None, None, None, None)]
    r = metrics.aggregated(spark.createDataFrame(rows, SCORED)).first()
    assert (r.n, r.em, r.recall_at_5, r.abst_correta, r.abst_indevida, r.alucinacao_sem_resposta, r.fonte_valida_pct) == (3, 0.5, 0.5, 0.0, 0.5, 1.0, 0.5)
    assert r.latencia_mediana_s == 2.0 and r.latencia_p95_s == pytest.approx(2.9) and r.perplexidade is None


def test_paired_gain(spark):
    rows = [("S3", w, f"q{i}", True, False, True, 1.0, int(w == "ajustado" or i > 2), 0.5, None, 1, 1.0) for i in range(6) for w in ("base", "ajustado")] + [("S1", "base", "q1", True, False, True, 1.0, 1, 1.0, None, 1, 1.0)]
    t = {r.metrica: r for r in metrics.paired_gain(spark.createDataFrame(rows, SCORED)).collect()}
    assert set(t) == {"em", "f1_tokens"} and t["em"].n_perguntas == 6 and t["em"].ganho_medio == 0.5 and t["em"].ic95_inf <= 0.5 <= t["em"].ic95_sup
    assert t["f1_tokens"].ganho_medio == 0 == t["f1_tokens"].ic95_sup


def test_bertscore_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def score(preds, refs, model, layers):
        calls.add(len(preds))
        return [float(p == r) for p, r in zip(preds, refs, strict=True)]

    rows = spark.createDataFrame([(1, True, False, "a", "a", None), (2, True, False, "a", "a", None), (3, True, True, "", "x", 0.0), (4, False, False, "b", "b", None)], "i int, answerable boolean, absteve boolean, pred string, ref string, bertscore_f1 double")
    out, values = metrics.with_bertscore(rows, score, None, "m", 9)
    assert {r.i: r.bertscore_f1 for r in out.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: None} and calls.value == 1
    again, _ = metrics.with_bertscore(rows, score, spark.createDataFrame(values.collect(), values.schema), "m", 9)
    seen = calls.value
    again.collect()
    assert calls.value == seen


def test_kappa(spark):
    a = spark.createDataFrame([(i, int(i < 6)) for i in range(10)], "id int, label int")
    b = spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "id int, label int")
    assert metrics.kappa(a, b).first().kappa == pytest.approx(0.8)


def test_generation_tries_three_seeds(spark):
    def reply(model, prompt):
        return json.dumps({"pergunta": "p", "resposta": "r"}) if "good" in prompt else "no"

    tasks = spark.createDataFrame([(0, "factual", "good"), (1, "factual", "bad"), (2, "sem_resposta", "good")], "place long, kind string, prompt string")
    t = models.generated(tasks, lambda: models.HashClient(reply=reply), "m", {}).collect()
    assert sorted((r.place, r.attempt) for r in t) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_clients():
    assert models.local_address("localhost:11434/").port == 11434 and models.local_address("http://[::1]:1").hostname == "::1"
    with pytest.raises(UserError):
        models.local_address("http://example.com")
    assert models.missing_models(["m", "m:1"], ["m:latest", "m:2"]) == ["m:1"]
    with pytest.raises(ModelError):
        models.require_models(models.HashClient(), ["other"])
    with pytest.raises(ModelError):
        models.HttpClient("http://127.0.0.1:9", timeout=1).available()


def test_perplexity(tmp_path):
    assert perplexity.parse("x\nFinal estimate: PPL = 8.4210 +/- 0.1\n") == 8.421
    with pytest.raises(ModelError):
        perplexity.parse("nothing")
    assert perplexity.latest(str(tmp_path)) is None
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "perplexidade.json").write_text("{}")
    assert perplexity.latest(str(tmp_path)).parent.name == "b"
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\necho 'Final estimate: PPL = 3.5'\n")
    tool.chmod(0o755)
    assert perplexity.measure(str(tool), "w", "t") == 3.5


def test_best_products_come_in_slices(monkeypatch):
    monkeypatch.setattr(R, "PRODUCTS", 90)
    draw = np.random.default_rng(3)
    q, v = draw.integers(-2, 3, (23, 4)).astype(float), draw.integers(-2, 3, (40, 4)).astype(float)  # many ties
    ids = draw.permutation(40) * 3
    for k in (1, 5, 40, 60):
        parts = list(R._best(q, ids, v, k))
        assert max(len(set(p.tolist())) for p, _, _ in parts) <= 2
        got = [(int(a), int(b), float(c)) for p in parts for a, b, c in zip(*p)]
        wanted = [(a, i, s) for a in range(23) for s, i in sorted(((q[a] @ v[j], int(ids[j])) for j in range(40)), key=lambda x: (-x[0], x[1]))[:k]]
        assert got == wanted
