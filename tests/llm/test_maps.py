"""Operators of one map stage: encoding, licences, fingerprints, classifier, decontamination."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, empty, table, text_of

from quillon.llm import bpe, decontam, license, quality, spotsigs
from quillon.llm.topk import top_k

# ---- 7


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(vocab):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={})


def random_texts(n, seed=0):
    draw = random.Random(seed)
    alphabet = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\r\n", "a", "b", "e", "th", "1", "!", " ", "é", "٣", "²", "　", "́", "😀", "中"]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(n)] + ["a" * k for k in range(40)]


def test_split_is_the_patterns(vocab):
    texts = random_texts(5000)
    assert vocab.split(texts) == [vocab.words.findall(t) for t in texts]


def test_merges_are_the_librarys(vocab, library):
    texts = random_texts(3000, 1) + [t for _, t in text_of(AWKWARD)]
    kept = {}
    for at in range(0, len(texts), 700):  # batches share what they know
        part = texts[at : at + 700]
        for t, ids in zip(part, vocab.encode_all(part, kept), strict=True):
            ids = np.frombuffer(ids, "<u4").tolist()
            assert ids == library.encode_ordinary(t)
            assert vocab.decode(ids) == t.encode()


def test_small_tables_change_nothing(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 10)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 7)
    texts = random_texts(50, 2)
    kept = {}
    assert [np.frombuffer(b, "<u4").tolist() for t in texts for b in vocab.encode_all([t], kept)] == [library.encode_ordinary(t) for t in texts]


def test_encode_documents(spark, library):
    out = bpe.encode_documents(table(spark)).collect()
    wanted = sorted((i or 0, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in text_of(AWKWARD))
    assert sorted((r.doc_id or 0, r.token_ids, r.decoded_sha256) for r in out) == wanted
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) and r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest() for r in out)
    assert bpe.encode_documents(empty(spark)).collect() == []


# ---- 3


def plain_scan(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    at = [(k, label) for p, label in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


NOTICES = [
    "Released under the MIT License.",
    "x mit license mit licenses é MIT-License",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "general public license" * 2,
]


def test_base_places():
    for t in [*NOTICES, *(t for _, t in text_of(AWKWARD)), *random_texts(200)]:
        assert license.scan(t.encode())[:5] == plain_scan(t)


@pytest.mark.parametrize(
    ("text", "template", "yes"),
    [
        ("a <<beginOptional>>b c<<endOptional>> d", "x a b c d y", True),
        ("a <<beginOptional>>b c<<endOptional>> d", "x a d y", True),
        ("a <<beginOptional>>b c<<endOptional>> d", "a b d", False),
        ("a <<var;original=q;match=.{0,2}>> d", "A d", True),
        ("a <<var;original=q;match=.{0,3}>> d", "a x, y D", True),
        ("a <<var;original=q;match=.{0,3}>> d", "a x y z d", False),
        ("a <<var;original=q;match=.{1,2}>> d", "a d", False),
        ('copyright <<var;name="c";original="<2020> A";match=".+">> all rights', "Copyright (c) 2021 Some One. All rights", True),
        ('copyright <<var;name="c";original="<2020> A";match=".+">> all rights', "Copyright all rights", False),
        ('a <<var;name="n";original="its";match="its|their own">> b', "a Their own b", True),
        ('a <<var;name="n";original="its";match="its|their own">> b', "a their b", False),
        ('a <<var;name="n";original="";match=".*">> <<var;name="m";original="";match="[0-9]+">> b', "a x y 12 b", True),
        ("<<beginOptional>>z<<endOptional>> a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e", "a b d e", True),
        ("<<beginOptional>>z<<endOptional>> a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e", "z a c e", False),
        ("mandatory wording only", "mandatory wordings only", False),
    ],
)
def test_automata(text, template, yes):
    a = license.Automaton(text)
    words = license.words(template.encode())
    assert a.found(words, b" " + b" ".join(words) + b" ") is yes


@pytest.mark.parametrize("broken", ["a <<endOptional>>", "<<beginOptional>> a", "a <<var;name=x>> b", "a <<other>> b", "a <<var;match=.+ b", "a >> b"])
def test_broken_markup_is_an_error(broken):
    with pytest.raises(ValueError):
        license.Automaton(broken)


@pytest.mark.parametrize("name", list(license.TEMPLATES))
def test_a_megabyte_of_beginnings_takes_seconds(name):
    a = license.AUTOMATA[name]
    plain = re.sub(r"<<.*?>>", " x ", license.TEMPLATES[name])
    grant = " ".join(plain.split()[:-1]) + " "  # all but its last word, again and again, and its longest wording alone
    text = (grant * (1_000_000 // len(grant)) + "filler " * 100).encode() + a.key
    found = license.words(text)
    began = time.monotonic()
    wanted = a.found(license.words(license.TEMPLATES[name].encode()), a.key)
    a.found(found, b" " + b" ".join(found) + b" ")
    license.scan((plain.split()[0] + " ").encode() * 150_000 + a.key)
    assert time.monotonic() - began < 8 and wanted in (True, False)


def test_one_pass_finds_what_every_beginning_finds():
    draw = random.Random(33)
    for template in ('a <<var;name="v";original="";match=".+">> b <<var;name="v";original="";match=".{0,4}">> c', '<<var;name="v";original="";match=".*">> a b', "a <<beginOptional>>b<<endOptional>> a c", 'a <<var;name="v";original="";match="b+|c d">> e'):
        a = license.Automaton(template)
        for _ in range(400):
            text = [draw.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(draw.randint(0, 14))]
            each = a.key in b" " + b" ".join(text) + b" " and any((a.begins is None or w in a.begins) and a.accepts(text, k) >= 0 for k, w in enumerate(text))
            assert a.found(text, b" " + b" ".join(text) + b" ") is each, (template, text)


def test_automata_accept_what_a_plain_matcher_does():
    draw = random.Random(31)
    for _ in range(300):
        def piece(depth=0):
            x = draw.random()
            if x < 0.6 or depth > 2:
                return " ".join(draw.choice("abc") for _ in range(draw.randint(1, 2)))
            if x < 0.8:
                return f"<<beginOptional>>{piece(depth + 1)} {piece(depth + 1)}<<endOptional>>"
            return '<<var;name="v";original="q";match=".*">>'
        template = " ".join(["a", *(piece() for _ in range(draw.randint(1, 4))), "b"])
        pattern = re.compile("(?:^|(?<= ))" + "".join({"<<beginOptional>>": "(?:", "<<endOptional>>": ")?"}.get(x, "(?:[^ ]+ )*" if x.startswith("<<var") else x + " ") for x in re.findall(r"<<[^>]*>>|[abc]", template)))
        automaton = license.Automaton(template)
        for _ in range(20):
            text = [draw.choice("abcd") for _ in range(draw.randint(0, 9))]
            found = automaton.found([w.encode() for w in text], (" " + " ".join(text) + " ").encode())
            assert found is bool(pattern.search(" ".join(text) + " ")), (template, text)


def filled(template):
    """The template's text with all optional regions and the originals."""
    return license._MARK.sub(lambda m: "" if m[1] else next(a or b for k, a, b in license._FIELD.findall(m[2]) if k == "original"), template)


@pytest.mark.parametrize("name", sorted(license.TEMPLATES))
def test_templates_accept_their_texts_and_no_near_misses(name):
    draw, a = random.Random(32), license.AUTOMATA[name]
    text = license.words(filled(license.TEMPLATES[name]).encode())
    ask = lambda t: a.found(t, b" " + b" ".join(t) + b" ")
    assert ask([b"x", *text, b"y"])
    mandatory = license.words(re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", re.sub(r"<<var[^>]*>>", " ", license.TEMPLATES[name], flags=re.S), flags=re.S).encode())
    for _ in range(10):  # another word in the place of a mandatory one
        w = draw.choice(sorted(set(mandatory)))
        assert not ask([b"zzz" if x == w else x for x in text])


def test_two_and_three_clauses_are_told_apart():
    two, three = (license.scan(filled(license.TEMPLATES[n]).encode())[5].split(",") for n in ("bsd-2-clause", "bsd-3-clause"))
    assert "bsd-2-clause" in two and "bsd-3-clause" not in two and "bsd-3-clause" in three and "bsd-2-clause" not in three


def test_license_documents(spark):
    rows = AWKWARD + [(100 + k, t) for k, t in enumerate(NOTICES)]
    out = {r.doc_id: r for r in license.scan_documents(table(spark, rows)).collect()}
    assert out[100].labels == "mit,mit-notice" and out[100].score == 1 and out[102].labels == "apache,apache-2.0-notice" and "gpl-3.0-notice" in out[103].labels
    assert out[101].score == 0.5 and out[3].n_words == 0 and out[3].first_word is None and out[8].n_words == 30_000
    assert license.scan_documents(empty(spark)).count() == 0


# ---- 5


def test_edited_fingerprints(spark):
    out = spotsigs.edited_fingerprints(table(spark)).collect()
    order = sorted(text_of(AWKWARD), key=lambda x: (x[0] is not None, x[0]))
    followers = {}
    for k, (i, t) in enumerate(order):
        followers.setdefault(i, []).append((t, order[(k + 1) % len(order)][1]))
    assert len(out) == len(AWKWARD)
    for r in out:
        possible = followers[r.doc_id]
        assert r.edited_sha256 in {hashlib.sha256(spotsigs.edited(t, n).encode()).hexdigest() for t, n in possible}
        assert r.n_chars == len(possible[0][0])
        signs = [(spotsigs.signatures(t), spotsigs.signatures(spotsigs.edited(t, n)), spotsigs.signatures(n)) for t, n in possible]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (r.near_edited, r.near_next) in {(jaccard(a, b), jaccard(a, c)) for a, b, c in signs}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1 and by[3].fingerprint == by[4].fingerprint
    assert len({r.fingerprint for r in out}) == len({t for _, t in text_of(AWKWARD)})
    assert spotsigs.edited_fingerprints(empty(spark)).count() == 0
    one = spotsigs.edited_fingerprints(table(spark, [(5, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_pruned_likeness_is_the_jaccard_index():
    draw = random.Random(30)
    for _ in range(2000):
        x, y = (sorted(draw.sample(range(60), draw.randint(0, 55))) for _ in range(2))
        both, either = len(set(x) & set(y)), len(set(x) | set(y))
        real = both / either if either else 1.0
        for least in (0.0, 0.3, 0.8):
            found = spotsigs.pruned_likeness(np.array(x, np.int64), np.array(y, np.int64), least)
            assert found == (real if real >= least and x and y else found) and (found >= least) == (real >= least or (least == 0 and not x))


def test_near_pairs_are_those_of_brute_force(spark):
    draw = random.Random(3)
    words = ["the", "of", "and", *(f"w{k}" for k in range(40))]
    base = [[draw.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(60):
        t = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(60)] = draw.choice(words)
        rows.append((k, " ".join(t)))
    pairs, members = spotsigs.near_pairs(table(spark, rows), 0.7)
    classes = {}
    for i, t in rows:
        classes.setdefault(frozenset(spotsigs.signatures(t)), i)
    names = sorted(classes.items(), key=lambda x: x[1])
    wanted = {(a, b) for k, (x, a) in enumerate(names) for y, b in names[k + 1 :] if spotsigs.likeness(x, y) >= 0.7}
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == wanted and wanted
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: classes[frozenset(spotsigs.signatures(t))] for i, t in rows}


def test_spotsigs_words_are_those_of_the_pattern():
    draw = random.Random(9)
    kinds = [chr(c) for c in (*range(1, 0x250), 0x301, 0x660, 0xB2, 0x2160, 0x3000, 0x4E00, 0x1F600, 0xD800)]
    for size in (0, 1, 5, 30, 3000):
        for _ in range(20):
            t = "".join(draw.choices(draw.sample(kinds, draw.choice((5, 20, 500))), k=size))
            assert spotsigs.words(t) == spotsigs.WORD.findall(t)


def test_common_counts_what_sets_share():
    draw = random.Random(8)
    sets = [np.array(sorted({*draw.sample(range(30), 20), *draw.sample(range(100, 2000), 40)}), np.int64) for _ in range(50)] + [np.zeros(0, np.int64)]
    found = spotsigs.common(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(51) for j in range(i + 1, 51))


@pytest.mark.parametrize("holders, block", [(1, 1000), (3, 4)])
def test_near_pairs_of_large_groups_come_from_blocks(spark, holders, block):
    draw = random.Random(4)
    words = ["the", "of", "and", *(f"w{k}" for k in range(300))]
    base = [draw.choice(words) for _ in range(120)]
    rows = []
    for k in range(30):  # one group of near copies of several lengths, and texts beside it
        t = base[: draw.randint(90, 120)] if k % 5 else [draw.choice(words) for _ in range(80)]
        for _ in range(draw.randint(0, 4)):
            t[draw.randrange(len(t))] = draw.choice(words)
        rows.append((k, " ".join(t)))
    rows.append((40, rows[1][1]))
    found = [tuple(sorted((r.a, r.b))) for r in spotsigs.near_pairs(table(spark, rows), 0.6, holders=holders, block=block)[0].collect()]
    sets = {i: spotsigs.signatures(t) for i, t in rows[:-1]}
    wanted = {(a, b) for a in sets for b in sets if a < b and spotsigs.likeness(sets[a], sets[b]) >= 0.6}
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 50


# ---- 4


def test_top_k_is_exact(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([draw.randint(-(2**62), 2**62), draw.randint(-3, 3)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k long").cache()
    for k in (0, 1, 5, 177, 499, 500, 900):
        wanted = {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:k]}
        assert {r.i for r in top_k(df, "k", "i", k).collect()} == wanted


def labelled(n=300, seed=4):
    draw = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "re", "ti") for b in ("lo", "ma", "nu") for c in ("s", "n", "t", "r")]
    docs, labels = [], []
    for i in range(n):
        t = " ".join(draw.choice(words) for _ in range(draw.randint(5, 80)))
        good = i % 3 > 0
        docs.append((i, t + "." if good else draw.choice([t.upper() + "!!", t.replace(" ", "$$$ "), t.replace(" ", " | ")])))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_labels_are_found(spark):
    docs, labels = labelled()
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.resample(table(spark, docs), known).collect()}
    wrong = [i for i, good in labels if i % 2 == 0 and (i in kept) != bool(good)]
    assert len(wrong) <= 3
    assert {r.doc_id for r in quality.keep_good(table(spark, docs), known).collect()} == kept


def test_weights_and_sample_are_those_of_brute_force(spark):
    docs, labels = labelled(120)
    docs += [(500, None), (501, ""), (502, "no such words 1 2 3")]
    out = {r.doc_id: r for r in quality.weigh(table(spark, docs), quality.fit(table(spark, docs), spark.createDataFrame(labels + labels[:9], "doc_id long, quality int"))[0]).collect()}
    raw, target = [1] * quality.SIZE, [0] * quality.SIZE
    good = {i for i, q in labels if q}
    for i, t in docs:
        for b in quality.features(t or "").tolist():
            raw[b] += 1
            target[b] += i in good
    n, m = sum(raw), sum(target)
    rights = []
    for smooth in quality.SMOOTHS:  # each labelled text by the counts of the others
        right = {True: [], False: []}
        for i, t in docs[:120]:
            found = quality.features(t).tolist()
            own = Counter(found) if i in good else Counter()
            left = m - sum(own.values())
            w = sum(math.log((target[b] - own[b] + smooth * m * raw[b] / n) / (left + smooth * m) * n / raw[b]) for b in found)
            margin = (w + math.log(2 * len(good) / len(labels))) * (1 if i in good else -1)
            right[i in good].append(1 / (1 + math.exp(-max(margin, -700))))
        rights.append((round(sum(sum(x) / len(x) for x in right.values()), 6), smooth))
    smooth = max(rights)[1]
    chance = lambda b: (target[b] + smooth * m * raw[b] / n) / (m * (1 + smooth))
    weights = {i: sum(math.log(chance(b) * n / raw[b]) for b in quality.features(t or "").tolist()) for i, t in docs}
    assert {i: round(w, 6) for i, w in weights.items()} == {i: round(r.log_weight, 6) for i, r in out.items()}
    found = quality.resample(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _ in docs], "i long").selectExpr("i", f"shiftrightunsigned(xxhash64(cast(i as string), {quality.SEED}), 12) as h").collect()}
    keys = {i: w - math.log(-math.log((hashes[i] + 0.5) / 2**52)) for i, w in weights.items()}
    k = sum(w > -math.log(2 * len(good) / len(labels)) for w in weights.values())
    assert {r.doc_id for r in found} == set(sorted(keys, key=keys.get)[-k:])
    assert all(r.gumbel_key == pytest.approx(keys[r.doc_id]) for r in found)


def test_features_are_hashed_one_by_one(monkeypatch):
    monkeypatch.setattr(quality, "KEPT_TOKENS", 3)
    draw = random.Random(8)
    for _ in range(200):
        t = " ".join(draw.choice(["the", "The", "THE", "A", "x9X", "42", "!!", "%%% ###", "_", "é", "Éa", "中"]) for _ in range(draw.randint(0, 12)))
        a, b = quality.features(t), quality.features(t)
        n = len(quality.TOKEN.findall(t))
        assert a.tolist() == b.tolist() and len(a) == max(0, 4 * n - 1)
        assert all(x < quality.BUCKETS for x in a[: max(0, 2 * n - 1)]) and all(quality.BUCKETS <= x < quality.SIZE for x in a[max(0, 2 * n - 1) :])
    assert [quality.shape(t) for t in ("the", "The", "THE", "A", "x9X", "42", "!!!!!!!!!!!", "é", "中")] == ["a", "Aa", "A", "x", "x", "9", "!!!!!!!!", "a", "x"]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_labels_that_the_fit_has_not_seen(spark, scale):
    """A third of the labels is held out: nine tenths of the good texts among them are kept, nine tenths of the others go."""
    folder = f"/root/testdata/{scale}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = [r for r in labels.collect() if r.doc_id % 3 == 1]
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 3 <> 1")).select("doc_id").collect()}
    for kind in (0, 1):
        own = [(r.doc_id in kept) == bool(kind) for r in held if r.quality == kind]
        assert len(own) > 2 and sum(own) >= 0.9 * len(own), (kind, sum(own), len(own))


def test_noise_samples_in_proportion(spark):
    docs = [(0, "aa bb"), (1, "cc dd"), *((k, "x y") for k in range(2, 4000))]
    kept = {r.doc_id for r in quality.resample(table(spark, docs, extra=False), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"), k=1000).collect()}
    assert len(kept) == 1000 and 200 < sum(i < 1000 for i in kept) < 300  # equal weights: any are as likely


def test_classifier_edges(spark):
    marks = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    out = quality.resample(table(spark), marks, k=4).collect()
    assert 4 <= len(out) <= 5
    nobody = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.resample(table(spark), nobody).count() == len(AWKWARD)
    assert quality.resample(empty(spark), marks).count() == 0
    kept = quality.keep_good(table(spark), nobody)
    assert kept.count() == len(AWKWARD) and kept.columns == table(spark).columns


# ---- 2


def items(n=30, seed=5):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    return [(k, " ".join(draw.choice(words) for _ in range(draw.randint(12, 50))) + ("? yes" if k % 3 == 0 else "")) for k in range(n)]


def test_wand_is_exact():
    index = decontam.Index(items(100))
    draw = random.Random(6)
    words = list(index.row)
    for _ in range(300):
        terms = set(draw.sample(words, 20)) | set(decontam.tokens(draw.choice(items(100))[1])[: draw.randint(0, 40)])
        scores = {}
        for t in terms & set(words):
            for k, w in zip(*index.posting(index.row[t]), strict=True):
                scores[k] = scores.get(k, 0) + w
        rows = np.array(sorted({index.row[t] for t in terms & set(words)}))
        for least in (0.05, 0.2, 0.5, 0.9):
            assert {k for k, _ in index.search(rows, least)} == {k for k, s in scores.items() if s >= least}


def test_contamination(spark):
    bench = items()
    draw = random.Random(7)
    filler = [f"f{k}" for k in range(300)] + ["the", "of"] * 40
    rows, wanted = [], set()
    for i in range(60):
        t = [draw.choice(filler) for _ in range(draw.randint(0, 400))]
        if i % 2:
            k, passage = draw.choice(bench)
            p = passage.upper().split()
            if i % 4 == 1 and len(p) > 40:
                p[5] = "changed"
            if i % 10 == 5:  # half of it is no contamination
                p = p[: len(p) // 2]
            else:
                wanted.add((i, k))
            at = draw.randint(0, len(t))
            t[at:at] = [*p, "."]
        rows.append((i, " ".join(t)))
    b = spark.createDataFrame([*bench, (99, None), (98, "  ")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(table(spark, rows), b).collect()} == wanted
    kept = decontam.drop_contaminated(table(spark, rows + AWKWARD), b)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([i for i, _ in rows if i not in {d for d, _ in wanted}] + [i or 0 for i, _ in AWKWARD if i not in {d for d, _ in wanted}])
    assert kept.columns == table(spark).columns
    assert decontam.contamination(empty(spark), b).count() == 0 and decontam.contamination(table(spark), b.where("false")).count() == 0


def test_index_shards_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 7)
    bench = items()
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert [len(g) for g in decontam.index_shards(b)] == [7, 7, 7, 7, 2]
    found = decontam.contamination(table(spark, [(k, t) for k, t in bench]), b).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(k, k) for k, _ in bench}
    monkeypatch.setattr(decontam, "SCAN_SHARDS", 2)
    whole = lambda rows: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in rows)
    again = decontam.contamination(table(spark, [(k, t) for k, t in bench]), b).collect()
    monkeypatch.undo()
    once = decontam.contamination(table(spark, [(k, t) for k, t in bench]), b).collect()
    assert whole(found) == whole(again) and {x[:2] for x in whole(once)} == {x[:2] for x in whole(found)}


@pytest.mark.parametrize("wide", [2, 256])
def test_windows_are_passed_over_exactly(monkeypatch, wide):
    monkeypatch.setattr(decontam, "WIDE", wide)
    monkeypatch.setattr(decontam, "BOUNDS", 200)
    draw = random.Random(33)
    bench = items(120) + [(500, " ".join(f"w{draw.randrange(400)}" for _ in range(700)))]
    index = decontam.Index(bench)
    for n in (0, 1, 4, 90, 1500):
        words = [draw.choice(bench)[1].split()[0] if draw.random() < 0.2 else f"w{draw.randrange(500)}" for _ in range(n)]
        for k in range(n // 100):
            at = draw.randrange(n)
            words[at:at] = decontam.tokens(bench[k][1])
        rows = np.array([index.row.get(w, 0) for w in words], np.int64)
        for stride in (7, 20):
            able = set(index.able_windows(rows, stride, 0.65))
            for at in range(0, max(1, -(-len(rows) // stride) - 2)):
                window = np.unique(rows[at * stride : (at + 3) * stride])
                assert at * stride in able or not index.search(window[window > 0], 0.65)


def test_one_long_item_widens_no_other_window():
    long = (900, " ".join(f"v{k}" for k in range(3000)))
    found = decontam.tiers([*items(40), long], decontam.Statistics(t for _, t in [*items(40), long]))
    assert [i.longest <= 64 for i in found] == [True, False] and found[1].ids == [900]
    text = decontam.tokens(long[1])
    assert found[1].hits(["x"] * 50 + text[:2700] + ["y"] * 50, 0.65, 0.8, 0.5).keys() == {0}
