"""Nearest neighbours by an inverted multi-index (after Babenko and Lempitsky, 2012).

Vectors are brought to length one and cut into two halves; each half is quantised to CENTROIDS centroids of its own, so a
pair of centroids names one of CENTROIDS^2 cells. A query sorts the centroids of both halves by distance and visits pairs
by the sum of the two distances, from a heap that holds the next pair of each row, until the visited cells have its share
of all entries. What it has visited is reranked by the exact cosine of the original vectors, in double precision.

The centroids are fitted on at most SAMPLE vectors, those with the least hash of their id; every vector is indexed. The
share is measured on the same sample: for TRIALS of its vectors it is known by brute force which cells hold the nearest
others, and the share is the least that reaches TARGET of them. It depends on the data alone: vectors without any
structure need most of the cells, clustered ones few. In a larger table neighbours are nearer, so the share errs upwards.

Equal vectors are one entry, with its least ids (one more than neighbours asked for: no other of them can be among the
nearest), and queries with equal vectors are answered once. So copies in any number make no large cell, and no pairs of
copies are formed. Entries of one row of cells are dealt into blocks of about ENTRY_BLOCK, queries into blocks of about
QUERY_BLOCK; each pair of blocks that have cells in common is one group of bounded size, and leaves the nearest few of
each query. A query sends its vector once to each block of a row of cells that it visits.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length is not
that of most vectors, nor rows with a null id. Rows of one id and vector count once; other rows with the query's id are
its own too, and are no candidates; if a query's rows have several vectors, the least of them asks. Ties go to the smaller id. With fewer candidates than asked for, all are returned;
an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import cut, join_classes, read, slices

CENTROIDS = 32
#: Bound of the sample on which centroids and share are fitted, rounds of the fit, and queries of the trial.
SAMPLE, ROUNDS, TRIALS = 8192, 20, 256
#: The share of true neighbours that the trial must find. Above what is promised (0.9), as the trial has its own error.
TARGET = 0.97
ENTRY_BLOCK, QUERY_BLOCK = 8192, 2048
#: Products held at once in a group; pairs whose exact cosine is found at once.
PRODUCTS, PAIRS = 1 << 22, 1 << 17
#: Above the error of a product of vectors of length one.
SLACK = 1e-9
SEED = 42


def usable(v: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above all numbers
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two, which changes no cosine and keeps squares in range."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims)
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, pair by pair: the same for the same pair, wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1), 0)


def fit_half(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds; a centroid without rows takes the row that is farthest from its own."""
    found = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = squared(x, found)
        own, least = d.argmin(axis=1), d.min(axis=1)
        sums, n = np.zeros_like(found), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        for c in np.flatnonzero(n == 0):
            far = int(least.argmax())
            sums[c], n[c], least[far] = x[far], 1, -1
        found = sums / n[:, None]
    return found


def nearest_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, entries: int) -> list[tuple[int, int]]:
    """Cells with entries, by the sum of the halves' distances, until they have so many entries."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[rows[0]] + second[columns[0]], 0, 0)], 0, []
    while heap and seen < entries:
        _, a, b = heapq.heappop(heap)
        i, j = int(rows[a]), int(columns[b])
        if counts[i, j]:
            seen += int(counts[i, j])
            out.append((i, j))
        if b + 1 < len(columns):
            heapq.heappush(heap, (first[i] + second[columns[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(rows):
            heapq.heappush(heap, (first[rows[a + 1]] + second[j], a + 1, 0))
    return out


def share_needed(u: np.ndarray, halves: tuple[np.ndarray, np.ndarray], neighbours: int, trials: int = TRIALS, target: float = TARGET) -> float:
    """The share of entries that queries must visit, so that they visit ``target`` of their nearest."""
    n, at = len(u), (u.shape[1] + 1) // 2
    if n < 2:
        return 1.0
    d = [squared(u[:, :at], halves[0]), squared(u[:, at:], halves[1])]
    cell = d[0].argmin(axis=1) * len(halves[1]) + d[1].argmin(axis=1)
    counts = np.bincount(cell, minlength=len(halves[0]) * len(halves[1]))
    q = np.arange(min(trials, n))
    near = u[q] @ u.T
    near[q, q] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(neighbours, n - 1)]
    sums = (d[0][q][:, :, None] + d[1][q][:, None, :]).reshape(len(q), -1)
    order = np.argsort(sums, axis=1, kind="stable")
    visited = np.empty_like(sums)
    np.put_along_axis(visited, order, np.cumsum(counts[order], axis=1) / n, axis=1)
    return float(np.quantile(np.take_along_axis(visited, cell[best], axis=1), target, method="higher"))


@dataclass(frozen=True)
class MultiIndex:
    """Entries (class_id, ids, v, i, j), one for each distinct vector, and what was fitted."""

    entries: DataFrame
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    share: float
    neighbours: int

    @staticmethod
    def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 5, centroids: int = CENTROIDS, sample: int = SAMPLE, target: float = TARGET, seed: int = SEED) -> MultiIndex | None:
        """The index of all usable vectors; None if there are none."""
        rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        dims = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        if dims is None:
            return None
        dims = dims["dims"]
        by_id = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        least = rows.where(F.size("v") == dims).distinct().withColumn("_r", by_id).where(F.col("_r") <= neighbours + 1)
        classes = cut(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "v"))
        chosen = classes.orderBy(F.xxhash64("class_id", F.lit(seed)), "class_id", "v").limit(sample).select("v").toArrow()  # a bounded sample
        u = unit(matrix(chosen.column("v"), dims))
        at, k = (dims + 1) // 2, min(centroids, len(u))
        halves = fit_half(u[:, :at], k, seed), fit_half(u[:, at:], k, seed + 1)
        shared = vectors.sparkSession.sparkContext.broadcast(halves)  # 2 x CENTROIDS vectors
        schema = StructType([*classes.schema, StructField("i", IntegerType()), StructField("j", IntegerType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = shared.value
            for batch in slices(batches):
                x = unit(matrix(batch.column("v"), dims))
                i, j = squared(x[:, :at], a).argmin(axis=1), squared(x[:, at:], b).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=[*batch.schema.names, "i", "j"])

        entries = cut(classes.mapInArrow(assign, schema))
        counts = np.zeros((k, k), np.int64)
        for r in entries.groupBy("i", "j").count().collect():  # CENTROIDS^2 rows at most
            counts[r.i, r.j] = r["count"]
        return MultiIndex(entries, *halves, counts, share_needed(u, halves, neighbours, target=target), neighbours)

    def visits(self, queries: DataFrame) -> DataFrame:
        """(query_class, i, js, v) for queries (class_id, v): the cells that a query visits, by the first half."""
        spark = queries.sparkSession
        dims, at = self.first.shape[1] + self.second.shape[1], self.first.shape[1]
        shared = spark.sparkContext.broadcast((self.first, self.second, self.counts))
        most = int(np.ceil(self.share * self.counts.sum()))
        v = queries.schema["v"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, counts = shared.value
            for whole in batches:
                for batch in slices([whole.slice(k, 256) for k in range(0, whole.num_rows, 256)]):
                    x = unit(matrix(batch.column("v"), dims))
                    source, rows, js = [], [], []
                    for n, (p, q) in enumerate(zip(squared(x[:, :at], a), squared(x[:, at:], b), strict=True)):
                        found: dict[int, list[int]] = {}
                        for i, j in nearest_cells(p, q, counts, most):
                            found.setdefault(i, []).append(j)
                        for i, own in found.items():
                            source.append(n)
                            rows.append(i)
                            js.append(own)
                    taken = batch.take(pa.array(source, pa.int64()))
                    yield pa.RecordBatch.from_arrays([taken.column("class_id"), pa.array(rows, pa.int32()), pa.array(js, pa.list_(pa.int32())), taken.column("v")], names=["query_class", "i", "js", "v"])

        return queries.select("class_id", "v").mapInArrow(run, f"query_class bigint, i int, js array<int>, v {v}")

    def nearest_classes(self, queries: DataFrame) -> DataFrame:
        """(query_class, found): for each of the distinct queries (class_id, v), its nearest entries (score, ids), one more
        than neighbours, as it may be one itself."""
        keep, dims = self.neighbours + 1, self.first.shape[1] + self.second.shape[1]
        k = self.counts.shape[1]
        blocks = F.element_at(F.array(*(F.lit(int(-(-n // ENTRY_BLOCK)) or 1) for n in self.counts.sum(axis=1))), F.col("i") + 1)
        parts = max(1, -(-queries.count() // QUERY_BLOCK))
        dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(SEED)), n).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        left = self.entries.withColumn("entry_block", dealt(F.col("class_id"), blocks)).withColumn("query_block", upto(F.lit(parts)))
        right = self.visits(queries).withColumn("query_block", dealt(F.col("query_class"), F.lit(parts))).withColumn("entry_block", upto(blocks))
        schema = pa.schema([("query_class", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

        def group(key: tuple, entries: pa.Table, asked: pa.Table) -> pa.Table:
            if not entries.num_rows or not asked.num_rows:
                return schema.empty_table()
            j = entries.column("j").to_numpy()
            order = np.argsort(j, kind="stable")
            bounds = np.searchsorted(j[order], np.arange(k + 1))
            e, q = matrix(entries.column("v"), dims)[order], matrix(asked.column("v"), dims)
            eu, qu = unit(e), unit(q)
            least = entries.column("class_id").to_numpy()[order]
            wants = np.zeros((len(q), k), bool)
            lists = asked.column("js").combine_chunks()
            wants[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
            pairs = []
            for c in range(k):
                lo, hi = bounds[c], bounds[c + 1]
                who = np.flatnonzero(wants[:, c])
                if lo == hi or not len(who):
                    continue
                step = max(1, PRODUCTS // (hi - lo))
                for s in range(0, len(who), step):
                    own = who[s : s + step]
                    near = qu[own] @ eu[lo:hi].T
                    bar = np.partition(near, -keep, axis=1)[:, -keep, None] - SLACK if hi - lo > keep else -np.inf
                    a, b = np.nonzero(near >= bar)
                    for at in range(0, len(a), PAIRS):
                        x, y = own[a[at : at + PAIRS]], lo + b[at : at + PAIRS]
                        pairs.append(first_of(x, y, cosine(q[x], e[y]), least, keep))
            x, y, score = first_of(*(np.concatenate(z) for z in zip(*pairs, strict=True)), least, keep) if pairs else (np.empty(0, int),) * 3
            return pa.table([asked.column("query_class").take(pa.array(x)), entries.column("ids").take(pa.array(order[y])), pa.array(score, pa.float64())], schema=schema) if len(x) else schema.empty_table()

        by = ["i", "entry_block", "query_block"]
        scored = left.select(*by, "j", "class_id", "ids", "v").groupBy(*by).cogroup(right.select(*by, "query_class", "js", "v").groupBy(*by)).applyInArrow(group, "query_class bigint, ids array<bigint>, score double")
        best = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), F.col("ids")[0]))
        return scored.withColumn("_r", best).where(F.col("_r") <= keep).groupBy("query_class").agg(F.collect_list(F.struct("score", "ids")).alias("found"))

    def search(self, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): the nearest entries of each query row, without those that have its own id."""
        dims = self.first.shape[1] + self.second.shape[1]
        rows = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector_col).alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == dims)).groupBy("query_id").agg(F.min("v").alias("v"))
        # equal vectors are asked once; a vector is named by the least id of its queries
        named = cut(rows.groupBy("v").agg(F.min("query_id").alias("class_id")))
        asked = cut(rows.join(named, "v").select("query_id", F.col("class_id").alias("query_class")))
        answers = cut(self.nearest_classes(named))
        each = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("id")))))
        others = F.slice(F.array_sort(F.filter(each, lambda x: x["id"] != F.col("query_id"))), 1, self.neighbours)
        ranked = join_classes(asked, answers, "query_class", "inner").select("query_id", F.posexplode(others).alias("at", "x"))
        return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def first_of(x: np.ndarray, y: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (x, y), the ``keep`` of each x with the greatest score, ties to the smaller id of y."""
    order = np.lexsort((ids[y], -score, x))
    x, y, score = x[order], y[order], score[order]
    begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    place = np.arange(len(x)) - np.repeat(begins, np.diff(np.r_[begins, len(x)]))
    return x[place < keep], y[place < keep], score[place < keep]


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def op11_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = MultiIndex.build(vectors)
    return index.search(vectors.where("vec_id % 50 = 0")) if index else spark.createDataFrame([], RESULT)
