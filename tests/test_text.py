"""Text expressions on fixed cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import metrics as M
from quillon.operators import models, verify

PHRASE = "Não encontrado no manual"


@pytest.fixture(scope="module")
def ev(spark):
    def run(expression, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))
        df = spark.createDataFrame([values], schema) if values else spark.range(1)
        return df.select(expression(*map(F.col, names)).alias("x")).first().x

    return run


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("A libera-\nção da carga", "A liberação da carga"),
        ("linha um\nlinha dois\n\nnovo  parágrafo\x07", "linha um linha dois\n\nnovo parágrafo"),
        ("ﬁscalização\t aduaneira", "fiscalização aduaneira"),
        ("até 15 km/\nh no pátio", "até 15 km/h no pátio"),
        ("Ex-\nPresidente", "Ex- Presidente"),
        ("so­ft, so­\nft", "soft, soft"),
        ("a\r\nb\rc d", "a b c d"),
        ("", ""),
    ],
)
def test_clean(ev, raw, clean):
    assert ev(T.clean, raw) == clean


def test_clean_composes(ev):
    assert ev(lambda c: T.clean(c, compose=True), "água") == "água"


@pytest.mark.parametrize(("line", "number"), [("4.2 Liberação de carga", "4.2"), ("1 Introdução", "1"), ("2.5 kg de carga máxima", None), ("1. Abra a tampa", None), ("Texto comum sem número", None)])
def test_title_number(ev, line, number):
    assert ev(T.title_number, line) == number


@pytest.mark.parametrize(
    ("new", "now", "ok"),
    [("1", "", True), ("2.4", "2.3", True), ("3", "2.3", True), ("2.3.1", "2.3", True), ("1", "13.1", False), ("201", "2.3", False), ("2.1", "1", True), ("3.1", "2.3", True), ("2.3", "2.3", False), ("2", "2.3", False), ("2.9", "2.3", False), ("2.4.7", "2.3", False), ("x", "1", False)],
)
def test_title_follows(ev, new, now, ok):
    assert ev(lambda a, b: T.title_follows(T.numbering(a), F.when(b != "", T.numbering(b))), new, now) is ok


def test_contents_line_and_key(ev):
    assert ev(T.is_contents_line, "4.2 Título ..... 17") and ev(T.is_contents_line, "4.2 Título… 17") and not ev(T.is_contents_line, "4.2 Título")
    assert ev(T.repetition_key, "  Página 3  de 6 ") == "Página de"


def test_tokens(ev, spark):
    assert ev(T.tokens, "Berço 202: 11,5 m (NR-29)") == ["berço", "202", "11", "nr", "29"]
    assert ev(lambda c: T.tokens(c, ["de"], keep_accents=False), "Liberação DE carga_x m³") == ["liberacao", "carga", "m3"]
    assert {"de", "para"} <= set(T.portuguese_stop_words())


@pytest.mark.parametrize(("words", "n"), [("um dois três", 4), ("", 1), ("a b c d e", 6)])
def test_token_estimate(ev, words, n):
    assert ev(lambda c: T.token_estimate(F.size(T.words(c))), words) == n


@pytest.mark.parametrize(("raw", "plain"), [("Até 48 horas, após a atracação!", "até 48 horas após atracação"), ("  O   prazo  do navio ", "prazo navio"), ("1.420 m", "1420 m"), ("1.2.3", "123"), ("o de a", ""), ("a_b", "b")])
def test_answer_text(ev, raw, plain):
    assert ev(T.answer_text, raw) == plain


@pytest.mark.parametrize(
    ("a", "b", "f1"),
    [("48 horas", "até 48 horas após a atracação", 2 * 0.4 / 1.4), ("", "algo", 0), ("", "", 1), ("o de a", "da do", 1), ("liberação", "liberacao", 0), ("abc", "xyz", 0), ("x x y", "x x x", 2 / 3)],
)
def test_token_f1(ev, a, b, f1):
    assert ev(M.token_f1, a, b) == pytest.approx(f1)


def test_exact_match_recall_and_rank(ev):
    assert ev(M.exact_match, "Até 48 horas após a atracação.", "até 48 horas após atracação") == 1
    assert ev(M.exact_match, "48 horas", "72 horas") == 0
    assert ev(M.reciprocal_rank, ["t1", "t2", "t3"], ["t3", "t2"]) == 0.5 and ev(M.reciprocal_rank, ["t1"], ["t9"]) == 0
    assert ev(M.recall, ["t1", "t2"], ["t2"]) == 1 and ev(M.recall, ["t1"], ["t9"]) == 0


@pytest.mark.parametrize(
    ("reply", "yes"),
    [("Não encontrado no manual.", True), ("NÃO ENCONTRADO NO MANUAL", True), ("nao encontrado no manual!", True), ("Resposta: Não encontrado no manual.", True), ("A carga é liberada em 48 horas (seção 2.2, p. 5).", False), ("Não encontrado.", False)],
)
def test_abstains(ev, reply, yes):
    assert ev(lambda c: T.abstains(c, F.lit(PHRASE)), reply) is yes
    assert ev(lambda c: T.abstains(c, F.lit(" .")), reply) is False


@pytest.mark.parametrize(
    ("reply", "cited"),
    [
        ("A carga sai em 48 horas (seção 4.2, p. 17).", [("4.2", 17)]),
        ("Ver seção 4.2.", [("4.2", None)]),
        ("Conforme p. 17 do manual.", [(None, 17)]),
        ("Está na página 17.", [(None, 17)]),
        ("Na pág. 9 e na (seção {3.1}, p. {12}).", [(None, 9), ("3.1", 12)]),
        ("Sem citação alguma; capítulo cap. 3.", []),
        ("SEÇÃO 2, P. 3", [("2", 3)]),
    ],
)
def test_citations(ev, reply, cited):
    assert [tuple(c) for c in ev(T.citations, reply)] == cited


@pytest.mark.parametrize(("cited", "ok"), [(("4.2", 18), True), ((None, 3), True), (("4.2", 3), False), (("9.9", None), False), ((None, None), False)])
def test_source_valid(spark, cited, ok):
    chunks = "array(named_struct('section_id', '4.2', 'page_start', 17, 'page_end', 18), named_struct('section_id', '2.1', 'page_start', 3, 'page_end', 3))"
    df = spark.createDataFrame([([cited],)], "c array<struct<section:string,page:int>>").select(F.expr(chunks).alias("t"), "c")
    assert df.select(verify.source_valid(F.col("c"), F.col("t")).alias("x")).first().x is ok
    assert df.select(verify.source_valid(F.col("c"), F.filter("t", lambda _: F.lit(False))).alias("x")).first().x is False


@pytest.mark.parametrize(("reply", "plain"), [("A carga sai em 48 horas (seção 4.2, p. 17).", "A carga sai em 48 horas."), ("72 horas, seção 2.1, p. 3", "72 horas,"), ("Sem citação.", "Sem citação.")])
def test_without_citations(ev, reply, plain):
    assert ev(T.without_citations, reply) == plain


@pytest.mark.parametrize(("reply", "plain"), [("<think>x</think>Em até 48 horas.", "Em até 48 horas."), ("<think>sem fim", ""), ("antes</think>depois", "depois"), ("normal", "normal")])
def test_without_thinking(ev, reply, plain):
    assert ev(T.without_thinking, reply) == plain


@pytest.mark.parametrize(("reply", "found"), [('x {"pergunta": "q"} y', "q"), ("none", None), ('{"pergunta": ', None), ('{"pergunta": "a"} {"pergunta": "b"}', None)])
def test_json_object(ev, reply, found):
    assert ev(lambda c: T.json_object(c, "pergunta string")["pergunta"], reply) == found


def test_fill(ev):
    assert ev(lambda c: T.fill("{{x}} {a}!", a=c), "b") == "{x} b!"
    with pytest.raises(KeyError):
        T.fill("{a}", b=F.lit(1))


def test_hash_embedding_is_the_same_in_both_engines(spark):
    words = ["berço", "202", "navio", "a" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for d in (64, 1000, 1024):
        found = [r.b for r in df.select(V.bucket(F.col("w"), d).alias("b")).collect()]
        assert found == [int(models.hash_vector(w, d).argmax()) for w in words]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.x for r in df.select(V.l2_normalised(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.select(V.checked_dimension(F.col("v"), 3)).collect()


def test_all_that_composition_changes_is_sent_to_it():
    import unicodedata

    import regex

    pattern = regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), T.UNCOMPOSED))
    chars = [chr(c) for c in range(0x300, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    missed = [c for c in chars if (unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or 0x1161 <= ord(c) <= 0x1175 or 0x11A8 <= ord(c) <= 0x11C2) and not pattern.match(c)]
    assert not missed
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x300))


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_composed_and_decomposed_texts_are_the_same(ev, form):
    import unicodedata

    text = unicodedata.normalize(form, "Liberação da carga; água, 각")
    assert ev(T.tokens, text) == ["liberação", "da", "carga", "água"]
    assert ev(lambda a, b: M.exact_match(a, b), text, "liberação da carga água 각") == 1
    assert ev(lambda a, b: M.token_f1(a, b), text, "liberação da carga água 각") == 1.0
    assert ev(V.embedding_tokens, text) == ["liberação", "da", "carga", "água"]
    assert models.hash_vector(text, 64).tolist() == models.hash_vector("liberação da carga; água, 각", 64).tolist()
    assert ev(lambda c: T.clean(c, compose=True), text) == unicodedata.normalize("NFC", text)


N = 100_000


@pytest.mark.parametrize(
    ("expression", "text", "value"),
    [
        (T.is_contents_line, "." * N + "x", False),
        (T.is_contents_line, ". " * N + "17", True),
        (T.is_contents_line, "…" * N, False),
        (T.is_contents_line, "1 " * N, False),
        (lambda c: F.size(T.citations(c)), "seção 1" + ".1" * N, 1),
        (lambda c: F.size(T.citations(c)), "seção" + " " * N + "x", 0),
        (lambda c: F.size(T.citations(c)), "p." + " " * N + "{" + " " * N + "3", 1),
        (lambda c: F.size(T.citations(c)), "seção 1, " * 10_000, 10_000),
        (lambda c: F.length(T.without_citations(c)), "(seção 1" + ".1" * N + ", p. 3)", 0),
        (lambda c: F.length(T.without_citations(c)), "(seção " * N, 7 * N - 1),
        (lambda c: F.length(T.without_citations(c)), "a" + " " * N + "b" + "-" * N + "c", N + 4),
        (lambda c: F.length(T.strip(c)), "a" + " " * N + "b", N + 2),
        (lambda c: F.length(T.clean(c)), "a-" + " " * N + "b" + " " * N + "\n" + " " * N + "c", 6),
        (lambda c: F.length(T.without_thinking(c)), "<think>" * N, 0),
        (lambda c: T.json_object(c, "a int").isNull(), "{" * N, True),
        (lambda c: T.json_object(c, "a int").isNull(), "}" * N + "{" * N, True),
        (lambda c: T.json_object(c, "a int")["a"], "x" * N + '{"a": 3}' + "y" * N, 3),
        (lambda c: T.title_number(c).isNull(), "1" + ".1" * N + " A", True),
    ],
)
def test_long_texts_neither_crash_nor_stall(ev, expression, text, value):
    assert ev(expression, text) == value


def test_normal_forms_are_pythons_in_every_script(spark):
    import random
    import unicodedata

    draw = random.Random(17)
    known = [chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    some = draw.sample(known, 4000) + ["".join(draw.choice(known[:3000]) + chr(draw.randrange(0x300, 0x370)) for _ in range(3)) for _ in range(500)] + ["Ελλάδα", "наждак й", "हिन्दी", "각 가나", "ﬁ ½ ㎏ Å", None, ""]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    for r in df.select("t", T.composed(F.col("t")).alias("c"), T.without_accents(F.col("t")).alias("a")).collect():
        assert (r.c, r.a) == ((None, None) if r.t is None else (unicodedata.normalize("NFC", r.t), plain(r.t))), repr(r.t)


def test_tokens_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("é x",)], "t string")
    plan = df.select(T.tokens(F.col("t")), T.answer_text(F.col("t")), T.without_accents(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classes_of_many_ranges_are_entered_from_their_first_character_on(spark):
    """Java tries all ranges of a class for a character outside it; plain letters must fail the first."""
    assert T.combining_marks().startswith(r"[\x{300}-\x{1efff}&&[")
    assert not T.SPACES.startswith("(?U)")
    points = [chr(c) for c in range(1, 0x1F100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in points], "c string").select("c", F.col("c").rlike(T.combining_marks()).alias("mark"), F.col("c").rlike(T.SPACES).alias("space"))
    found = df.collect()
    assert {r.c for r in found if r.mark} == {c for c in points if ord(c) < 0x1F000 and unicodedata.combining(c)}
    assert {r.c for r in found if r.space} == {c for c in points if not c.split()}
