"""Lexical, dense and fused retrieval as joins and windowed top-k.

Ranked lists are (q_id, id, score, rank). Ties go to the smaller id; scores are compared at six decimals, so that the
order of additions can't decide a rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import UserError
from ..functions import text as T
from ..sources.store import written

K1, B = 1.5, 0.75
#: What stands for a text without tokens, so that it counts as one of length one.
EMPTY_TOKEN = "_vazio_"
MODES = ("none", "lexical", "dense", "hybrid")
#: Questions' terms, repeats in other questions counted, that are broadcast to the postings: some 10 MB.
SENT_TERMS = 100_000
#: Vectors in a block of queries and in a block of the index; products that are held at once.
QUERY_BLOCK, INDEX_BLOCK, PRODUCTS = 2048, 8192, 1 << 20
#: Bytes of texts that are taken apart at once.
SLICE = 1 << 23


def top(scored: DataFrame, k: int, by: Sequence[str] = ("q_id",)) -> DataFrame:
    """The k best of each query, with rank from 1; score rounded to six decimals."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokenised(texts: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (), keep_accents: bool = True) -> DataFrame:
    """(id, tokens, dl), the sentinel for texts without tokens."""
    found = T.tokens(F.coalesce(F.col(text_col), F.lit("")), stop_words, keep_accents)
    # bound to a name, a text is split once, however often its tokens are looked at
    once = F.transform(F.array(found), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(EMPTY_TOKEN))))
    counted = F.transform(once, lambda t: F.struct(t.alias("tokens"), F.size(t).alias("dl")))
    return texts.select(F.col(id_col).alias("id"), F.inline_outer(counted))


class LexicalIndex:
    """postings (id, term, tf, dl), terms (term, df, idf, avgdl) and totals (n, avgdl): three tables."""

    def __init__(self, postings: DataFrame, terms: DataFrame, totals: DataFrame, packed: tuple[DataFrame, list[str]] | None = None):
        self.postings, self.terms, self.totals = postings, terms, totals
        self.packed = packed  # rows (id, v) of an index for few terms, and the terms

    @classmethod
    def build(cls, texts: DataFrame, id_col: str = "id", text_col: str = "text", stop_words: Sequence[str] = (), keep_accents: bool = True, only_terms: DataFrame | None = None) -> LexicalIndex:
        """only_terms: (term); an index for a known set of questions needs no postings of other words. Its postings are
        written in one pass over the texts, as frequencies, totals and every search read them; those of SENT_TERMS terms
        at most as one row an id."""
        if only_terms is not None and len(known := only_terms.select("term").where("term is not null").distinct().limit(SENT_TERMS + 1).collect()) <= SENT_TERMS:
            return cls._packed(texts, id_col, text_col, stop_words, keep_accents, sorted(r.term for r in known))
        docs = tokenised(texts, id_col, text_col, stop_words, keep_accents)
        if only_terms is None:
            words = docs.select("id", "dl", F.explode_outer("tokens").alias("term"))  # never empty; a plain explode tests that by splitting again
            postings = words.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
            totals = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        else:
            # each text has a row of no word beside, which keeps its length
            words = docs.select("id", "dl", F.explode_outer(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
            wanted = only_terms.select("term").unionByName(only_terms.sparkSession.range(1).select(F.lit("").alias("term")))
            parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            dealt = words.join(wanted, "term", "left_semi").repartition(parts, "id")  # a text's words stay together, which a shuffle packs well
            stored = written(dealt.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")))
            postings = stored.where("term <> ''")
            totals = stored.where("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
        # asks for tf, which is never below one, so that both uses of postings are the same plan and run once
        found = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).join(F.broadcast(totals))
        terms = found.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
        return cls(postings, terms, totals)

    @classmethod
    def _packed(cls, texts: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str], keep_accents: bool, names: list[str], anchors: list[str] | None = None) -> LexicalIndex:
        """An index for few terms: a text's postings are a row, made where the text is read, and all of an id lie together.

        anchors: the same reading also counts each text's words and finds the anchors in it (``holders``, of the lower-case
        text with spaces collapsed): columns n_words, one entry a text, and held, places in the list, of the packed rows.
        """
        stops = sorted(set(T.left_out(stop_words, keep_accents)))
        spark, size = texts.sparkSession, max(1, len(names))
        shared = spark.sparkContext.broadcast((names, stops, anchors))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, stops, anchors = shared.value
            find = None if anchors is None else finder(anchors)
            stopped = pa.array(stops, pa.string())
            wanted = pa.array(stops + [x for x in names if x not in set(stops)], pa.string())
            # the code of each, -1 for a stop word
            codes = np.array([-1] * len(stops) + [i for i, x in enumerate(names) if x not in set(stops)], np.int64)
            vacant = [i for i, x in enumerate(names) if x == EMPTY_TOKEN]
            for batch in slices(batches):
                pieces = split_plain(batch.column("spaced"))
                row = np.repeat(np.arange(len(pieces)), pieces.value_lengths().to_numpy())
                words = pieces.flatten()
                place = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy()
                token = (pc.utf8_length(words).to_numpy() > 1) & ((place < 0) | (place >= len(stopped)))
                dl = np.bincount(row[token], minlength=len(pieces))
                met = token & (place >= 0)
                key = row[met] * size + codes[place[met]]
                for code in vacant:  # a text without tokens
                    key = np.concatenate((key, np.flatnonzero(dl == 0) * size + code))
                key, tf = np.unique(key, return_counts=True)
                starts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=len(pieces))))), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (key % size, tf)]
                out = {"id": batch.column("id"), "dl": pa.array(np.maximum(dl, 1), pa.int32()), "codes": lists[0], "tfs": lists[1]}
                if find:
                    rows, held, n_words = find(batch.column("text"))
                    starts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(pieces))))), pa.int32())
                    out |= {"n_words": pa.array(n_words, pa.int32()), "held": pa.ListArray.from_arrays(starts, pa.array(held, pa.int32()))}
                yield pa.RecordBatch.from_pydict(out)

        kind = texts.schema[id_col].dataType.simpleString()
        text = F.coalesce(F.col(text_col), F.lit(""))
        read = texts.select(F.col(id_col).alias("id"), T.spaced(text, keep_accents).alias("spaced"), *([] if anchors is None else [F.lower(text).alias("text")]))
        rows = read.mapInArrow(pack, f"id {kind}, dl int, codes array<int>, tfs array<int>" + ("" if anchors is None else ", n_words int, held array<int>"))
        beside = [] if anchors is None else [F.collect_list("n_words").alias("n_words"), F.flatten(F.collect_list("held")).alias("held")]
        packed = written(rows.groupBy("id").agg(F.collect_list(F.struct("dl", "codes", "tfs")).alias("v"), *beside))
        totals = packed.select(F.inline("v")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        called = spark.createDataFrame(list(enumerate(names)), "code int, term string")
        each = packed.select("id", F.inline("v")).select("id", "dl", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("tfs").alias("tf"))))
        postings = each.groupBy("id", "dl", "code").agg(F.sum("tf").alias("tf")).join(F.broadcast(called), "code").select("id", "term", "dl", "tf")
        # of texts with one id and one length a term counts once
        several = F.transform(F.array_distinct(F.flatten(F.transform("v", lambda x: F.transform(x["codes"], lambda c: F.struct(x["dl"].alias("dl"), c.alias("code")))))), lambda x: x["code"])
        found = packed.select(F.explode(F.when(F.size("v") == 1, F.col("v")[0]["codes"]).otherwise(several)).alias("code")).groupBy("code").agg(F.count("*").alias("df"))
        terms = found.join(F.broadcast(called), "code").join(F.broadcast(totals)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
        return cls(postings, terms, totals, (packed, names))

    def save(self, path: str) -> None:
        """Postings lie in order of their term, so that a scan for a few terms skips row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        index = cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "totals")))
        n = index.totals.first()
        if n is None or index.postings.select("id").distinct().count() != n.n:
            raise UserError(f"index in {path} is incomplete; build it again")
        return index

    def weights(self, k1: float = K1, b: float = B) -> Column:
        return F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    def scores(self, questions: DataFrame, k1: float = K1, b: float = B, stop_words: Sequence[str] = (), keep_accents: bool = True) -> DataFrame:
        """(q_id, id, score > 0) for questions (q_id, text); a token that occurs twice counts twice."""
        asked = question_terms(questions, stop_words, keep_accents)
        few = asked.count() <= SENT_TERMS
        # a row for each term, with its questions: postings are joined once and fan out only when they are summed
        asked = asked.groupBy("term").agg(F.collect_list(F.struct("q_id", "times")).alias("q")).join(self.terms, "term")
        # many are joined by shuffle, so that the fan-out runs in as many tasks as there are partitions
        postings = self.postings
        if few:
            # dealt by text before they fan out, so that scores aren't shuffled
            parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            postings = postings.join(F.broadcast(asked.select("term")), "term", "left_semi").repartition(parts, "id")
        asked = F.broadcast(asked) if few else asked.hint("shuffle_hash")
        weighed = postings.join(asked, "term").select("id", "q", self.weights(k1, b).alias("w"))
        return weighed.select("id", "w", F.inline("q")).groupBy("q_id", "id").agg(F.sum(F.col("w") * F.col("times")).alias("score"))

    def search(self, questions: DataFrame, k: int = 5, k1: float = K1, b: float = B, **options) -> DataFrame:
        return self.searches(questions, k, [(k1, b)], **options).drop("run")

    def searches(self, questions: DataFrame, k: int, weights: Sequence[tuple[float, float]], stop_words: Sequence[str] = (), keep_accents: bool = True) -> DataFrame:
        """A search for each (k1, b), as (run, q_id, id, score, rank); of an index for few terms in one pass."""
        asked = question_terms(questions, stop_words, keep_accents)
        if self.packed is None or asked.count() > SENT_TERMS:
            lists = [top(self.scores(questions, k1, b, stop_words, keep_accents), k).withColumn("run", F.lit(run)) for run, (k1, b) in enumerate(weights)]
            return reduce(DataFrame.unionByName, lists)
        packed, names = self.packed
        place = {x: i for i, x in enumerate(names)}
        idf, avgdl = np.zeros(len(names)), 1.0
        for r in self.terms.collect():  # bounded, as the questions' terms are
            idf[place[r.term]], avgdl = r.idf, r.avgdl
        rows = sorted(((place[r.term], r.q_id, r.times) for r in asked.collect() if r.term in place), key=lambda r: r[0])
        ids = {q: i for i, q in enumerate(dict.fromkeys(q for _, q, _ in rows))}
        starts = np.searchsorted([c for c, _, _ in rows], np.arange(len(names) + 1))
        kinds = [f.dataType for f in (questions.schema["q_id"], packed.schema["id"])]
        sent = packed.sparkSession.sparkContext.broadcast((idf, starts, np.array([ids[q] for _, q, _ in rows], np.int64), np.array([n for _, _, n in rows], np.float64), list(ids)))
        types = [to_arrow_type(x) for x in kinds]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, starts, q_of, times, q_ids = sent.value
            best = [Best(k, pa.array([], types[1])) for _ in weights]
            step = max(1, PRODUCTS // max(1, len(q_ids)))
            for batch in batches:
                for at in range(0, batch.num_rows if len(q_of) else 0, step):
                    part = batch.slice(at, step)
                    doc, dl, code, tf = unpacked(part.column("v"))
                    many = starts[code + 1] - starts[code]
                    each = np.repeat(np.arange(len(code)), many)
                    asked = np.arange(len(each)) - np.repeat(np.cumsum(many) - many - starts[code], many)
                    cell = doc[each] * len(q_ids) + q_of[asked]
                    for kept, (k1, b) in zip(best, weights, strict=True):
                        w = idf[code] * tf / (tf + k1 * (1 - b + b * dl / avgdl))
                        kept.add(np.bincount(cell, w[each] * times[asked], part.num_rows * len(q_ids)).reshape(part.num_rows, -1), part.column("id"))
            q_ids = pa.array(q_ids, types[0])
            for i, kept in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept.q), i), pa.int32()), q_ids.take(pa.array(kept.q)), kept.ids, pa.array(kept.score)], names=["run", "q_id", "id", "score"])

        found = packed.select("id", "v").sortWithinPartitions("id").mapInArrow(run, f"run int, q_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double")
        return top(found, k, ("run", "q_id"))


#: Bytes of UTF-8, with a space for those of ASCII that are no letters or digits.
PLAIN = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def split_plain(texts: pa.Array) -> pa.ListArray:
    """The pieces of texts between characters of ASCII other than letters and digits, empty ones among them. No nulls."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = PLAIN[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
    return pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)), " ")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE bytes, as what is made of a text's words is several times the text."""
    for batch in batches:
        step = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def unpacked(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, dl, code, tf) of each posting of rows of texts; those of one row, length and term are one."""
    dl, codes, tfs = v.flatten().flatten()
    text = np.repeat(np.arange(len(dl)), codes.value_lengths().to_numpy())
    row, dl = np.repeat(np.arange(len(v)), v.value_lengths().to_numpy())[text], dl.to_numpy()[text]
    code, tf = codes.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.float64)
    if pc.max(v.value_lengths()).as_py() == 1:
        return row, dl, code, tf
    order = np.lexsort((code, dl, row))
    row, dl, code, tf = (x[order] for x in (row, dl, code, tf))
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (dl[1:] != dl[:-1]) | (code[1:] != code[:-1])
    return row[first], dl[first], code[first], np.bincount(np.cumsum(first) - 1, tf, int(first.sum()))


class Best:
    """The k best of each query so far; rows come in order of their ids, so a later one never wins a tie."""

    def __init__(self, k: int, ids: pa.Array):
        self.k, self.q, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0), ids

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: a row for each id, a column for each query, zero where they have no term in common."""
        found = scores > 0
        scores = np.round(scores, 6)
        full = np.flatnonzero(np.bincount(self.q, minlength=scores.shape[1]) >= self.k)
        least = np.full(scores.shape[1], -1.0)
        least[full] = self.score[np.searchsorted(self.q, full, "right") - 1]
        row, q = np.nonzero(found & (scores > least))
        all_q, score = np.concatenate((self.q, q)), np.concatenate((self.score, scores[row, q]))
        order = np.lexsort((np.arange(len(all_q)), -score, all_q))
        all_q = all_q[order]
        kept = np.arange(len(all_q)) - np.searchsorted(all_q, all_q) < self.k
        order = order[kept]
        self.q, self.score = all_q[kept], score[order]
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(row))]).take(pa.array(order))


def question_terms(questions: DataFrame, stop_words: Sequence[str] = (), keep_accents: bool = True) -> DataFrame:
    """(q_id, term, times)."""
    found = questions.select("q_id", F.explode(T.tokens(F.coalesce("text", F.lit("")), stop_words, keep_accents)).alias("term"))
    return found.groupBy("q_id", "term").agg(F.count("*").alias("times"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (id, vec) in blocks (ids, vecs flat, width) of about ``size``; nulls and empty vectors are left out."""
    kept = vectors.where("id is not null and size(vec) > 0")
    n = max(1, -(-kept.count() // size))
    dealt = kept.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(n)))
    packed = dealt.groupBy("_block").agg(F.collect_list(F.struct("id", "vec")).alias("v"))
    return packed.select(F.transform("v", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("v", lambda x: x["vec"])).cast("array<double>").alias("flat"))


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, ids, scores) of the k best rows of v for each query, ties to the smaller id, in slices of queries."""
    k, step = min(k, len(ids)), max(1, PRODUCTS // len(ids))
    for at in range(0, len(q), step):
        scores = q[at : at + step] @ v.T
        np.round(scores, 6, out=scores)
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        rows, columns = np.nonzero(scores >= least[:, None])  # k a query, and ties with the last of them
        found = scores[rows, columns]
        order = np.lexsort((ids[columns], -found, rows))
        rows = rows[order]
        first = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(scores)))))
        kept = order[np.arange(len(rows)) - first[rows] < k]
        yield at + np.sort(rows[np.arange(len(rows)) - first[rows] < k]), ids[columns[kept]], found[kept]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """The k vectors (id, vec) of greatest inner product for each query (q_id, vec): exact, block against block.

    Ids are longs. Each pair of blocks is one matrix product, of which k rows a query go on; so what is shuffled grows
    with queries times index blocks, not with pairs.
    """
    asked = blocks(queries.select(F.col("q_id").alias("id"), "vec"), query_block).select(F.col("ids").alias("q_ids"), F.col("flat").alias("q"))
    stored = blocks(vectors, index_block)
    schema = "q_id bigint, id bigint, score double"
    out = pa.schema([("q_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, q_ids = (batch.column(c)[row].values.to_numpy() for c in ("ids", "q_ids"))
                v, q = (batch.column(c)[row].values.to_numpy().reshape(len(i), -1) for c, i in (("flat", ids), ("q", q_ids)))
                for places, best, scores in _best(q, ids, v, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[places]), pa.array(best), pa.array(scores)], schema=out)

    pairs = stored.join(asked.hint("shuffle_replicate_nl"))  # blocks, not rows
    return top(pairs.mapInArrow(run, schema), k)


def fused(lists: Sequence[DataFrame], c: int = 60, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (c + rank)."""
    union = lists[0].select("q_id", "id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("q_id", "id", "rank"))
    return top(union.groupBy("q_id", "id").agg(F.sum(1.0 / (F.lit(c) + F.col("rank"))).alias("score")), k)


def retrieve(mode: str, questions: DataFrame, lexical: LexicalIndex | None = None, dense: tuple[DataFrame, DataFrame] | None = None, k: int = 5, depth: int = 20, c: int = 60, **options) -> DataFrame:
    """Ranked chunks of the questions (q_id, text). dense: (query vectors, index vectors). ``none`` gives no rows."""
    if mode not in MODES:
        raise UserError(f"unknown retrieval mode {mode!r}; one of {', '.join(MODES)}")
    if k < 1 or depth < 1:
        raise UserError("k and depth must be positive")
    if mode in ("lexical", "hybrid") and lexical is None:
        raise UserError(f"mode {mode} needs a lexical index")
    if mode in ("dense", "hybrid") and dense is None:
        raise UserError(f"mode {mode} needs vectors")
    if mode == "none":
        return questions.where("false").select("q_id", F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if mode == "lexical":
        return lexical.search(questions, k, **options)
    if mode == "dense":
        return nearest(*dense, k)
    depth = max(k, depth)
    return fused([lexical.search(questions, depth, **options), nearest(*dense, depth)], c, k)


def earliest(docs: DataFrame, most: int) -> DataFrame:
    """The documents (id, n_tokens, turn) that have fewer than ``most`` others of at most their size before them in order.

    Whoever takes documents in order, each that fits what is left, and leaves out some, ends up with these, as long as
    it takes or leaves out fewer than ``most``: an earlier one that is no larger fits too. They are about ``most`` times
    the logarithm of the corpus: each task keeps those of its own rows, and one task those of what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[int] = []  # the sizes of the ``most`` smallest so far, negative, the largest first
        for batch in batches:
            kept = []
            for k, n in enumerate(batch.column("n_tokens").to_pylist()):
                if len(least) < most:
                    heapq.heappush(least, -n)
                elif n < -least[0]:
                    heapq.heapreplace(least, -n)
                else:
                    continue
                kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    few = docs.sortWithinPartitions("turn", "id").mapInArrow(run, docs.schema)
    return few.repartition(1).sortWithinPartitions("turn", "id").mapInArrow(run, docs.schema)


def distractors(ranked: DataFrame, evidence: DataFrame, chunks: DataFrame, wanted: int = 3, budget: int = 1400, seed: int = 42) -> DataFrame:
    """(q_id, place, id): chunks beside the evidence (q_id, id) for a training prompt.

    Retrieved chunks in order of rank, then all others in the order of a seeded hash (one order for every question);
    those that don't fit the token budget are passed over, until ``wanted`` are taken.
    """
    ranked, evidence = ranked.persist(), evidence.persist()  # a few rows a question
    sizes = written(chunks.select("id", F.col("n_tokens").cast("bigint").alias("n_tokens")))  # texts are counted once
    gold = evidence.join(sizes, "id").groupBy("q_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n")).where(F.col("used") <= budget).persist()
    # what a question leaves out: its evidence and what was retrieved for it
    passed = gold.join(ranked.groupBy("q_id").agg(F.count("*").alias("hits")), "q_id", "left").agg(F.max(F.col("n") + F.coalesce("hits", F.lit(0)))).first()[0] or 0
    ordered = sizes.where(F.col("n_tokens") <= budget).withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), "id")))
    others = earliest(ordered, wanted + passed)
    first = ranked.join(sizes, "id").select("q_id", "id", "n_tokens", F.lit(0).alias("late"), F.lpad(F.col("rank").cast("string"), 9, "0").alias("turn"))
    fits = F.col("n_tokens") <= F.lit(budget) - F.col("used")
    rest = gold.select("q_id", "used").join(F.broadcast(others), fits).join(ranked.select("q_id", "id"), ["q_id", "id"], "left_anti").select("q_id", "id", "n_tokens", F.lit(1).alias("late"), "turn")
    listed = first.unionByName(rest).join(evidence, ["q_id", "id"], "left_anti").join(gold, "q_id").groupBy("q_id", "used").agg(F.array_sort(F.collect_list(F.struct("late", "turn", "id", "n_tokens"))).alias("c"))
    start = F.struct(F.col("used").cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))

    def take(acc: Column, x: Column) -> Column:
        ok = (F.size(acc["ids"]) < wanted) & (acc["used"] + x["n_tokens"] <= budget)
        return F.struct(F.when(ok, acc["used"] + x["n_tokens"]).otherwise(acc["used"]).alias("used"), F.when(ok, F.concat(acc["ids"], F.array(x["id"].cast("string")))).otherwise(acc["ids"]).alias("ids"))

    return listed.select("q_id", F.posexplode(F.aggregate("c", start, take, lambda acc: acc["ids"])).alias("place", "id"))


#: Characters of the anchors in one automaton, some 60 bytes each in a task's memory.
SHARD_CHARS = 1 << 20


def anchor_shards(anchors: DataFrame, chars: int | None = None) -> list[DataFrame]:
    """Distinct anchors (anchor) in parts of about ``chars`` characters (SHARD_CHARS), by their hash."""
    distinct = anchors.select("anchor").distinct()
    total = distinct.agg(F.sum(F.length("anchor"))).first()[0] or 0
    n = max(1, -(-total // (chars or SHARD_CHARS)))
    return [distinct.where(F.pmod(F.xxhash64("anchor"), F.lit(n)) == k) for k in range(n)]


def finder(names: list[str], collapsed: bool = True) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function from texts to (rows, places of the names that the texts in them hold, numbers of words of all texts), by an
    Aho-Corasick automaton. collapsed: with one space where a text has white space, none at its ends; else words are not counted."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, name in enumerate(names):
        automaton.add_word(name, k)
    automaton.make_automaton()

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, held, n_words = [], [], np.zeros(len(texts), np.int32)
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            if collapsed:
                words = text.split()  # at the white space of ``text.SPACES``
                n_words[i], text = len(words), " ".join(words)
            own = sorted({k for _, k in automaton.iter(text)}) if text and names else ()
            rows += [i] * len(own)
            held += own
        return np.array(rows, np.int64), np.array(held, np.int64), n_words

    return find


def holders(anchors: DataFrame, texts: DataFrame, chars: int | None = None, collapsed: bool = False) -> DataFrame:
    """(anchor, id): the texts (id, text) that contain each anchor (anchor), wherever in them, once each. collapsed: as if
    all white space in a text were single spaces, and none at its ends.

    All anchors of a part are looked for in one pass over a text, by an Aho-Corasick automaton: the time is that of the
    text and of what is found. A part is broadcast, and each part is one scan of the texts, which are not shuffled.
    """
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    found = []
    for part in anchor_shards(anchors, chars):
        names = [r.anchor for r in part.where("anchor <> ''").collect()]  # bounded by the part's characters
        if not names:
            continue
        shared = spark.sparkContext.broadcast(names)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = shared.value
            find = finder(names, collapsed)
            for batch in batches:
                rows, held, _ = find(batch.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(held)), batch.column("id").take(pa.array(rows))], names=["anchor", "id"])

        found.append(texts.select("id", "text").mapInArrow(run, f"anchor string, id {kind}"))
    if not found:
        return texts.where("false").select(F.lit("").alias("anchor"), "id")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def flat_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (q_id, anchor) as they are looked for: spaces collapsed, in lower case. Those without words are left out."""
    return anchors.select("q_id", F.lower(F.array_join(T.words(F.col("anchor")), " ")).alias("anchor")).where("anchor <> ''")


def anchor_evidence(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, id, n_chunks): chunks (id, text) whose text holds the anchor (q_id, anchor), both with spaces collapsed and
    in lower case. Anchors without words meet nothing; repeated rows of a chunk count each."""
    asked = flat_anchors(anchors)
    met = holders(asked, chunks.select("id", F.lower("text").alias("text")), collapsed=True)
    return asked.join(met, "anchor").select("q_id", "id").withColumn("n_chunks", F.count("*").over(Window.partitionBy("q_id")))


def surveyed(texts: DataFrame, questions: DataFrame, id_col: str = "id", text_col: str = "text", stop_words: Sequence[str] = (), keep_accents: bool = True) -> tuple[LexicalIndex, DataFrame, DataFrame]:
    """For questions (q_id, text): the index of their terms, (id, n_words) of every text, and (q_id, id) of the texts that hold
    a question's own (``anchor_evidence``), all in one reading of the texts.

    Questions of more than SENT_TERMS terms or SHARD_CHARS characters are answered by readings of their own.
    """
    terms = question_terms(questions, stop_words, keep_accents).select("term").distinct()
    anchors = questions.select("q_id", F.col("text").alias("anchor"))
    asked = flat_anchors(anchors)
    known, shards = terms.limit(SENT_TERMS + 1).collect(), anchor_shards(asked)
    if len(known) > SENT_TERMS or len(shards) > 1:
        index = LexicalIndex.build(texts, id_col, text_col, stop_words, keep_accents, terms)
        sizes = texts.select(F.col(id_col).alias("id"), F.size(T.words(F.coalesce(F.col(text_col), F.lit("")))).alias("n_words"))
        return index, sizes, anchor_evidence(anchors, texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("q_id", "id")
    names = sorted(r.anchor for r in shards[0].collect())
    index = LexicalIndex._packed(texts, id_col, text_col, stop_words, keep_accents, sorted(r.term for r in known), names)
    packed = index.packed[0]
    called = texts.sparkSession.createDataFrame(list(enumerate(names)), "code int, anchor string")
    met = packed.select("id", F.explode("held").alias("code")).join(F.broadcast(called), "code")
    return index, packed.select("id", F.explode("n_words").alias("n_words")), asked.join(met, "anchor").select("q_id", "id")
