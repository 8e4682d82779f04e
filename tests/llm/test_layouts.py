"""Nearest neighbours, fill-in-the-middle, co-bucketed tables: against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import AWKWARD, empty, table, text_of
from oracle import compare
from pyspark.sql import functions as F

from quillon.llm import cobucket, infill, multiindex
from quillon.llm.queries import ORACLES, QUERIES

# ---- 11


def plain_cosine(a, b):
    top = lambda v: max(map(abs, v))
    a, b = [x / top(a) for x in a], [x / top(b) for x in b]
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))


def answers(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r)
    return out


def test_sorted_pairs_come_from_the_heap():
    draw = np.random.default_rng(5)
    for _ in range(50):
        a, b, counts = draw.random(6), draw.random(7), draw.integers(0, 3, (6, 7))
        order = sorted((a[i] + b[j], i, j) for i in range(6) for j in range(7) if counts[i, j])
        for most in (0, 1, 5, 1000):
            seen, wanted = 0, []
            for _, i, j in order:
                if seen >= most:
                    break
                seen += counts[i, j]
                wanted.append((i, j))
            assert multiindex.nearest_cells(a, b, counts, most) == wanted


def test_nearest_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (7, [2.0, 4.0, 6.0]), (7, [2.0, 4.0, 6.0]), (3, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0, 0.0]), (100, [2.0**1000, 0.0, 0.0]), (11, [2.0**-1000, 0.0, 0.0])]
    rows += [(150, None), (200, []), (250, [0.0, 0.0, 0.0]), (1, [1.0, None, 0.0]), (2, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (300, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("i", F.lit(1))
    index = multiindex.MultiIndex.build(df, target=1.0)
    got = answers(index.search(df.where("vec_id % 50 = 0")).collect())
    good = dict(rows[:8]) | {300: [0.0, 0.0, 1.0]}
    assert sorted(got) == [0, 50, 100, 300]
    for q, found in got.items():
        wanted = sorted((-round(plain_cosine(good[q], v), 9), i) for i, v in good.items() if i != q)[:5]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-round(r.score, 9), r.vec_id) for r in found] == wanted
    assert multiindex.MultiIndex.build(df.limit(0)) is None
    alone = df.where("vec_id = 0")
    assert multiindex.MultiIndex.build(alone).search(alone).collect() == []
    assert QUERIES["op11_inverted_multi_index"].__doc__


def test_many_copies_are_one_entry(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "ENTRY_BLOCK", 40)
    monkeypatch.setattr(multiindex, "QUERY_BLOCK", 3)
    monkeypatch.setattr(multiindex, "PRODUCTS", 50)
    monkeypatch.setattr(multiindex, "PAIRS", 7)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 8))
    vectors = {i: base[0] if i < 400 else base[i % 300] for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    index = multiindex.MultiIndex.build(df, target=1.0)
    assert index.entries.count() == 300 and index.entries.agg(F.max(F.size("ids"))).first()[0] == 6
    whole = multiindex.MultiIndex(index.entries, index.first, index.second, index.counts, 1.0, 5)  # visits everything: exact
    got = answers(whole.search(df.where("vec_id % 50 = 0")).collect())
    v = np.array(list(vectors.values()))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 900, 50):
        s = u @ u[q]
        wanted = sorted((-round(float(s[i]), 9), i) for i in range(900) if i != q)[:5]
        assert [(-round(r.score, 9), r.vec_id) for r in got[q]] == wanted


def test_op11_recall(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, v = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got, hit = answers(QUERIES["op11_inverted_multi_index"](spark, sf_dir).collect()), 0
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    place = {int(i): k for k, i in enumerate(ids)}
    for i in asked:
        s = u @ u[place[i]]
        assert all(abs(r.score - s[place[r.vec_id]]) < 1e-12 for r in got[i]) and [r["rank"] for r in got[i]] == [1, 2, 3, 4, 5]
        s[place[i]] = -9
        hit += len(set(ids[np.argsort(-s)[:5]]) & {r.vec_id for r in got[i]})
    assert hit >= 0.9 * 5 * len(asked)


# ---- 12


def plain_middle(doc_id, text, seed=42, rate=50, spm=80):
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = struct.unpack(">4I", d[:16])
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < spm
    return len(units), "spm" if spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_the_plain_versions(spark):
    draw = random.Random(12)
    odd = [(20 + k, "".join(draw.choice(["a", "b ", "\n", "  ", "é😀", "<", "P>", "S", "<M", ">", "\x1c", "\x85 "]) for _ in range(draw.randint(0, 30)))) for k in range(150)]
    odd += [(900, "x" * 1_000_000), (901, " " * 1_000_000), (902, "w " * 300_000), (903, "ends <S> here")]
    plan = infill.Plan(rate=80)
    out = infill.fill_in_middle(table(spark, AWKWARD + odd).drop("b", "a"), plan=plan)
    assert {"blob", "score"} < set(out.columns)
    back = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), plan)).collect()
    assert sorted((r.doc_id or -1, r.n, r.form, r.prefix or "", r.middle or "", r.output) for r in back) == sorted((i or -1, *((x or "" if k in (2, 3) else x) for k, x in enumerate(plain_middle(i, t, rate=80)))) for i, t in text_of(AWKWARD + odd))
    assert all(r.back == (r.text or "") for r in back)
    assert len({r.form for r in back}) == 3
    assert infill.fill_in_middle(empty(spark)).collect() == []


def test_own_sentinels(spark):
    plan = infill.Plan(seed=7, rate=100, spm_rate=50, prefix="|pre>", suffix="{suf}", middle="[mid]")
    texts = [(k, f"one two {k} three  four") for k in range(40)] + [(99, "holds {suf}")]
    out = infill.fill_in_middle(table(spark, texts, extra=False), plan=plan).withColumn("back", infill.restored(F.col("output"), F.col("form"), plan)).collect()
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"psm", "spm", "plain"}
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "x<", "suffix": "<y"}, {"prefix": "aXa"}, {"rate": 101}):
        with pytest.raises(ValueError):
            infill.Plan(**bad)
    with pytest.raises(ValueError):
        infill.fill_in_middle(table(spark, texts).withColumn("form", F.lit(1)))


def test_op12_is_its_sql(spark, sf_dir):
    compare(spark, sf_dir, QUERIES["op12_fill_in_middle"], ORACLES["op12_fill_in_middle"])


# ---- 13

HEADS = "k long, name string, at timestamp_ntz"
DETAILS = "k long, item string, n double"


def order(rows):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    return sorted(rows, key=lambda r: [key(v) for v in r])


def plain_pair(heads, details, bucket, head_start, detail_start, orphan):
    """What the final files hold: (table, bucket) -> rows, whether rewritten, and rows by starting file."""
    known, out = {r[0] for r in heads} - {None}, {}
    for name, rows, start in (("heads", heads, head_start), ("details", details, detail_start)):
        by, lineage, goes = defaultdict(list), defaultdict(Counter), defaultdict(set)
        for r in rows:
            b = orphan + 1 if r[0] is None else bucket(r[0]) if r[0] in known else orphan
            by[b].append(r)
            lineage[b][start(r)] += 1
            goes[start(r)].add(b)
        for b, own in by.items():
            stays = len(lineage[b]) == 1 and len(goes[min(lineage[b])]) == 1
            out[name, b] = order(own), not stays, lineage[b]
    return out


def held_against(rows, wanted, heads, details, folder):
    n, m = Counter(r[0] for r in heads), Counter(r[0] for r in details)
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    assert sorted((r.table_name, r.bucket) for r in rows) == sorted(wanted)
    for r in rows:
        own, rewritten, lineage = wanted[r.table_name, r.bucket]
        there = pq.ParquetFile(r.path).read()
        assert ",".join(there.column_names) == r.columns
        assert [tuple(x.values()) for x in there.to_pylist()] == own
        assert (r.rewritten, r.n_rows) == (rewritten, len(own))
        assert r.ids_sha256 == sha("" if x[0] is None else str(x[0]) for x in own)
        assert r.lineage_sha256 == sha(f"{s}:{c}" for s, c in sorted(lineage.items()))
        ids = {x[0] for t in ("heads", "details", "sales", "sale_lines") if (t, r.bucket) in wanted for x in wanted[t, r.bucket][0]} - {None}
        assert r.n_joined == sum(n[i] * m[i] for i in ids)
    files = {str(p) for p in Path(folder).rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert files == {r.path for r in rows}


@pytest.mark.parametrize("fanout", [2, 3, 100])
def test_files_are_the_plain_versions(spark, tmp_path, fanout):
    import datetime as dt

    draw = random.Random(fanout)
    keys = [None, None, *range(25)]
    heads = [(draw.choice(keys), draw.choice(["a", "Z", "é", "", None, "a\x00b"]), draw.choice([None, dt.datetime(2024, 1, draw.randint(1, 28))])) for _ in range(40)]
    details = [(1 if draw.random() < 0.4 else draw.choice([*keys, 77, 78]), draw.choice(["x", "y", None, "😀"]), draw.choice([None, 1.5, -2.0])) for _ in range(300)]
    heads += heads[:5]
    pair = cobucket.Pair("k", buckets=7, salt="t", fanout=fanout)
    number = lambda k: zlib.crc32(f"t{k}".encode()) % 7
    a = spark.createDataFrame(heads, HEADS).repartition(3)
    start = F.coalesce(F.crc32(F.concat(F.lit("t"), F.col("k").cast("string"))) % 7, F.lit(7))
    head_start = F.when(start == 3, 2).otherwise(start)
    own = lambda r: 7 if r[0] is None else 2 if number(r[0]) == 3 else number(r[0])
    rows2 = [r for r in details if r[0] is None or r[1] is not None]  # each row has a starting file
    folder = f"{tmp_path}/again"
    rows = cobucket.co_bucket(a, spark.createDataFrame(rows2, DETAILS), head_start, F.when(F.col("k").isNull(), 5).otherwise(F.length("item")), 9, pair, ("heads", "details"), folder).collect()
    held_against(rows, plain_pair(heads, rows2, number, own, lambda r: 5 if r[0] is None else len(r[1]), 7), heads, rows2, folder)
    assert {r.rewritten for r in rows} == {True, False}
    with pytest.raises(ValueError):
        cobucket.co_bucket(a.select("name", "k"), a, head_start, head_start, 9, pair, ("heads", "details"), folder)
    with pytest.raises(ValueError):
        cobucket.write_start(a.withColumn("layout", F.lit(1)), head_start, 9, folder, folder)


def test_empty_tables_have_no_files(spark, tmp_path):
    pair = cobucket.Pair("k", buckets=3, fanout=2)
    a, b = spark.createDataFrame([], HEADS), spark.createDataFrame([(5, "x", 1.0), (5, "x", 1.0), (None, "y", None)], DETAILS)
    zero = F.lit(0)
    assert cobucket.co_bucket(a, b.limit(0), zero, zero, 5, pair, ("heads", "details"), f"{tmp_path}/0").collect() == []
    for k, (heads, details) in enumerate(((a, b), (spark.createDataFrame([(5, "h", None)], HEADS), b.limit(0)))):
        rows = cobucket.co_bucket(heads, details, zero, zero, 5, pair, ("heads", "details"), f"{tmp_path}/{k + 1}").collect()
        plain = [tuple(r) for r in heads.collect()], [tuple(r) for r in details.collect()]
        held_against(rows, plain_pair(*plain, lambda i: zlib.crc32(f"s{i}".encode()) % 3, lambda r: 0, lambda r: 0, 3), *plain, f"{tmp_path}/{k + 1}")


def test_op13(spark, sf_dir):
    rows = QUERIES["op13_radix_co_bucketing"](spark, sf_dir).collect()
    sales, lines = ([tuple(r.values()) for r in pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist()] for t in ("sales", "sale_lines"))
    bucket = lambda i: 601 if i is None else zlib.crc32(f"s{i}".encode()) % 600
    head = lambda r: bucket(r[0]) - (bucket(r[0]) % 4 == 1)
    plain = plain_pair(sales, lines, bucket, head, lambda r: 0 if r[2] is None else zlib.crc32(str(r[2]).encode()) % 600, 600)
    wanted = {("sales" if t == "heads" else "sale_lines", b): v for (t, b), v in plain.items()}
    held_against(rows, wanted, sales, lines, Path(rows[0].path).parents[2])


def test_digits():
    assert [cobucket.digits(n, f) for n, f in ((1, 2), (2, 2), (3, 2), (602, 25), (626, 25), (602, 1000))] == [1, 1, 2, 2, 3, 1]
    with pytest.raises(ValueError):
        cobucket.digits(5, 1)
