"""Token alignment against a plain version."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import alignment as A


def vector(token):
    marked, out = f"<{token}>", {}
    for g in [marked[i : i + 3] for i in range(max(1, len(marked) - 2))]:
        b = int(hashlib.md5(g.encode()).hexdigest(), 16) % 1024
        out[b] = out.get(b, 0) + 1
    return out


def cosine(a, b):
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if len(w) > 1] or [text]


def plain(pred, ref, weight=lambda w: 1.0):
    p, r = words(pred), words(ref)

    def mean(own, other):
        total = sum(map(weight, own))
        return sum(weight(w) * max(cosine(vector(w), vector(o)) for o in other) for w in own) / total if total else 0.0

    a, b = mean(p, r), mean(r, p)
    return a, b, 2 * a * b / (a + b) if a + b else 0.0


def texts(n, seed=3):
    draw = random.Random(seed)
    stems = ["carga", "cargas", "descarga", "porto", "portuária", "navio", "x", "42", "é", "a-b", "!"]
    return [" ".join(draw.choice(stems) for _ in range(draw.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 22, 4096, 1])
def test_blocks_and_tiles_change_nothing(monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "KEPT", 4)
    preds, refs = texts(40), texts(40, 4)
    found = A.alignment_f1(preds, refs)
    assert found == pytest.approx([plain(p, r)[2] for p, r in zip(preds, refs, strict=True)])
    assert A.alignment_f1([], []) == []
    assert A.alignment_f1(["porto", "", "a"], ["porto", "", "porto"]) == pytest.approx([1.0, 1.0, 0.0])


def test_weights_come_from_the_references(spark):
    preds, refs = texts(60, 5), texts(60, 6)
    pairs = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip(preds, refs, strict=True))] + [(100, None, "x"), (101, "x", None), (102, "nunca visto", "porto")], "key int, pred string, ref string")
    idf = A.inverse_frequencies(pairs, "ref")
    known = [set(words(r)) for r in [*refs, "x", "porto"]]
    weight = {w: math.log((len(known) + 1) / (sum(w in k for k in known) + 1)) for k in known for w in k}
    assert {r.token: round(r.idf, 9) for r in idf.collect()} == {w: round(x, 9) for w, x in weight.items()}
    most = max(weight.values())
    got = {r.key: (r.precision, r.recall, r.f1) for r in A.alignment(pairs, "key", idf).collect()}
    assert set(got) == {*range(60), 102}
    for i, (p, r) in enumerate(zip(preds, refs, strict=True)):
        assert got[i] == pytest.approx(plain(p, r, lambda w: weight.get(w, most)))
    assert A.alignment(pairs.limit(0), "key", idf.limit(0)).collect() == []


def test_stored_pairs_are_not_scored_again(spark, tmp_path):
    made = lambda n: spark.createDataFrame([(f"k{i}", "porto novo", f"porto {i}0") for i in range(n)] * 2, "key string, pred string, ref string")
    path = f"{tmp_path}/cache"
    first = A.stored_alignment(made(3), path)
    assert first.count() == 3
    spark.read.parquet(path).withColumn("f1", F.lit(0.5)).write.parquet(f"{tmp_path}/marked")
    second = {r.key: r.f1 for r in A.stored_alignment(made(5), f"{tmp_path}/marked").collect()}
    assert len(second) == 5 and [k for k, v in second.items() if v == 0.5] and sum(v == 0.5 for v in second.values()) == 3
    assert spark.read.parquet(f"{tmp_path}/marked").count() == 5


def test_a_gram_is_hashed_once_for_all_tokens(monkeypatch):
    asked, md5 = [], A.hashlib.md5
    monkeypatch.setattr(A.hashlib, "md5", lambda x, **k: asked.append(x) or md5(x, **k))
    known = A._Buckets(1024)
    tokens = ["banana", "bananas", "ananas", "ba"]
    made = A._vectors([tokens, ["banana"]], known)
    assert len(asked) == len(set(asked)) == len({g for t in tokens for g in A.grams(t)})
    for t, v in zip(tokens, made[0], strict=True):
        n = np.bincount([int(md5(g.encode()).hexdigest(), 16) % 1024 for g in A.grams(t)], minlength=1024)
        assert (v == n / np.sqrt((n * n).sum())).all()
    assert (made[1, 0] == made[0, 0]).all() and not made[1, 1:].any()
