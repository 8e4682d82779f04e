"""The packing scan against plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking, packing, scan


def estimate(n, per_word):
    return max(1, round(n * per_word))


def plain_groups(rows, most, least, per_word):
    """rows: (idx, words, title, key) of a document in order -> lists of chunks (lists of idx), with whether each opens a segment."""
    segments, before = [[]], None
    for idx, words, title, key in rows:
        if title or key != before:
            segments.append([])
        before = key
        if not title:
            segments[-1].append((idx, words))
    out = []
    for own in filter(None, segments):
        groups = []
        for idx, words in own:
            if groups and estimate(sum(w for _, w in groups[-1]) + words, per_word) <= most:
                groups[-1].append((idx, words))
            else:
                groups.append([(idx, words)])
        chunks, held = [], []
        for g in groups:
            held += g
            if estimate(sum(w for _, w in held), per_word) >= least:
                chunks.append(held)
                held = []
        if held:
            chunks.append(held)
        out += [([i for i, _ in c], k == 0) for k, c in enumerate(chunks)]
    return out


@pytest.mark.parametrize(("most", "least", "per_word", "run", "span"), [(10, 4, 1.3, 1, 2), (10, 4, 1.3, 3, 2), (60, 20, 1.3, 5, 3), (1, 0, 2.0, 4, 2), (0, 9, 1.0, 2, 2), (25, 40, 0.5, 7, 2), (400, 60, 1.3, 4096, 1024)])
def test_runs_give_what_folds_give(spark, monkeypatch, most, least, per_word, run, span):
    monkeypatch.setattr(scan, "RUN", run)
    monkeypatch.setattr(scan, "SPAN", span)
    draw = random.Random(most + run)
    docs = {}
    for k, n in enumerate((1, 2, 40, 75, 30)):
        key, rows = "a", []
        for i in range(n):
            key = draw.choice("abc") if draw.random() < 0.1 else key
            rows.append((3 * i, draw.choice([0, 0, 1, 2, 3, 5, 8, 30]), draw.random() < 0.08, key))
        docs[f"d{k}"] = rows
    docs["titles"], docs[None] = [(i, 1, True, "a") for i in range(6)], [(i, 4, False, "a") for i in range(9)]
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in draw.sample(rows, len(rows))], "doc_id string, idx int, words int, title boolean, key string")
    placed, chunks = packing.packed(df, most, least, per_word)
    got = {}
    for r in placed.collect():
        got.setdefault((r.doc_id, r.chunk), []).append(r.idx)
    opens = {(r.doc_id, r.chunk): r.opens for r in chunks.collect()}
    wanted = {(d, k): c for d, rows in docs.items() for k, c in enumerate(plain_groups(rows, most, least, per_word), 1)}
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, (c, _) in wanted.items()}
    assert opens == {k: o for k, (_, o) in wanted.items()}


def test_most_words():
    for per_word in (0.3, 1.0, 1.3, 2.0, 7.5):
        for limit in (0, 1, 2, 7, 60, 400):
            for strict in (False, True):
                fits = [n for n in range(3000) if (estimate(n, per_word) < limit if strict else estimate(n, per_word) <= limit)]
                assert packing.most_words(limit, per_word, strict) == (fits[-1] if fits else -1)
    with pytest.raises(ValueError):
        packing.most_words(5, 0)


def test_a_million_paragraphs_under_one_heading(spark):
    n = 1_000_000
    words = (np.arange(n) * 7919 % 97) % 60
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("idx"), (F.col("id") * 7919 % 97 % 60).alias("words"), F.lit(False).alias("title"), F.lit("x").alias("key"))
    placed, chunks = packing.packed(df, 400, 60, 1.3)
    plain = plain_groups_fast(words.tolist())
    assert chunks.count() == len(plain) and chunks.where("opens").count() == 1
    first = {r.chunk: (r.a, r.b, r.n) for r in placed.groupBy("chunk").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n")).collect()}
    assert first == {k: (a, b - 1, b - a) for k, (a, b) in enumerate(plain, 1)}


def plain_groups_fast(words):
    groups, held, start = [], 0, 0
    for i, w in enumerate(words):
        if i > start and estimate(held + w, 1.3) > 400:
            groups.append((start, i, held))
            start, held = i, w
        else:
            held += w
    groups.append((start, len(words), held))
    out, begin, held = [], groups[0][0], 0
    for _, b, n in groups:
        held += n
        if estimate(held, 1.3) >= 60:
            out.append((begin, b))
            begin, held = b, 0
    return out + ([(begin, len(words))] if begin < len(words) else [])


def test_overlap_stays_within_a_segment(spark):
    rows = [(1, i, 1 + i // 4, "s" if i < 9 else "t", "1" if i < 9 else "2", " ".join(["w"] * 6 + [str(i)]), False) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id int, idx int, page int, section string, section_id string, text string, is_title boolean")
    made = {r.id: r for r in chunking.chunks(df, 20, 0, 1.3, overlap=1).collect()}
    last = {k: [int(t.split()[-1]) for t in r.text.split("\n")] for k, r in made.items()}
    assert last == {"t0001": [0, 1], "t0002": [1, 2, 3], "t0003": [3, 4, 5], "t0004": [5, 6, 7], "t0005": [7, 8], "t0006": [9, 10], "t0007": [10, 11, 12], "t0008": [12, 13]}
    assert made["t0002"].page_start == 1 and made["t0003"].n_paragraphs == 3
