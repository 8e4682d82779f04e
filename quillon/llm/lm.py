"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation in numpy.

The model (after Mnih and Teh, 2012) predicts the next symbol from the two before it: the vectors of the context, each
through the diagonal matrix of its position, add up to a prediction, whose product with a symbol's target vector, plus
its bias, is the symbol's score. Symbols are the end of a text, the WORDS most frequent words one by one, and TAIL
classes that share all other words by their last two bytes. A token's probability is that of its symbol, in a tail class
times its share of the class by add-one smoothed training counts, with one further unit a class for words never seen; so
probabilities over all words seen, and the unseen word of each class, add up to one.

All training tokens are learnt from. One pass counts words. A second one trains: every task goes over its own tokens in
minibatches, each of them set against NOISE symbols drawn from the unigram distribution, and climbs the noise-contrastive
objective by AdaGrad from the same first parameters; the tasks' parameters are averaged by their numbers of tokens
(iterative parameter mixing, McDonald et al., 2010), in two levels, so that no task or driver holds those of all tasks.
The normalisers of all contexts, SYMBOLS squared numbers, are found by batched matrix products, dealt over the tasks.
Scoring is then one product of prediction and target a token, less the normaliser of its context.

Words beyond the KNOWN most frequent ones are not broadcast: scoring sends each document's other words through a join
with the table of counts. Counts are combined before each shuffle, so a frequent word is no hot key.

A document is held out if crc32 of its id as text leaves 2 modulo 7. Null text is the empty text (one token, the end);
a null id counts as the text "". Empty tables give an empty result. If nothing is left to train on, all counts are zero
and every token has the unseen word's probability of an untrained model. Repeated rows are scored each. Only id and text
are read. The order of a table's rows and files decides which tokens share a minibatch, so scores of the same rows laid
out otherwise differ slightly; a task that runs again gives the same.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, raw_texts, read, slices
from .topk import top_k

#: Symbols: the end of a text is number 0, then come single words, then tail classes.
SYMBOLS, TAIL = 1536, 47
WORDS = SYMBOLS - TAIL - 1
#: Most words whose counts every task holds.
KNOWN = 200_000
#: Words counted in a task before the counts are passed on.
HELD_WORDS = 100_000
#: Bytes of text taken apart at once: a token in Python's memory is about ten times its text.
BATCH_BYTES = 2 << 20
#: Vectors' length; tokens of a minibatch, noise symbols drawn for it, noise tokens that these stand for, for each token.
DIM, MINIBATCH, NOISE, NOISE_RATIO = 16, 2048, 32, 8
RATE = 0.05
#: Numbers of a parameter row that a task sends; tasks whose rows are added up together.
SLOT, FAN = 4096, 64
#: Tokens scored at once.
SCORED = 50_000
FOLDS, HELD_OUT = 7, 2
LOG10 = math.log(10)


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; the end of the text is not included."""
    return text.lower().split()


def _source(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(key) % FOLDS == HELD_OUT).alias("held_out"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents; the end of a text is the word ""."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def out(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, BATCH_BYTES):
            for text in raw_texts(batch):
                counts.update(tokens(text))
                counts[b""] += 1
                if len(counts) > HELD_WORDS:
                    yield from out(counts)
                    counts.clear()
        yield from out(counts)

    return arrow_map(_source(docs).where("not held_out").select("text"), run, schema).groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The known words: their symbols, their counts, and each symbol's size."""

    def __init__(self, known: list[tuple[bytes, int]], words: int, tail: int, ends: int, tails: dict[int, tuple[int, int]], total: int, distinct: int):
        """known: words by falling count, then by word, of which the first ``words`` are symbols; ends: number of ends;
        tails: tokens and distinct words of each tail class."""
        self.words, self.tail, self.total, self.distinct = words, tail, total, distinct
        self.symbols = 1 + words + tail
        self.index = {b"": 0} | {w: k for k, (w, _) in enumerate(known, 1)}
        self.count = np.array([ends, *(c for _, c in known)], np.int64)
        self.symbol = np.array([0, *(k if k <= words else self.tail_symbol(w) for k, (w, _) in enumerate(known, 1))], np.int64)
        self.mass = np.zeros(self.symbols, np.int64)  # training tokens of each symbol
        self.mass[0] = ends
        for k, (_, c) in enumerate(known[:words], 1):
            self.mass[k] = c
        self.sizes = self.mass + 1  # one unit is a single word's own, in tail classes the unseen word's
        for k, (n, v) in tails.items():
            self.mass[k] = n
            self.sizes[k] = n + v + 1

    def tail_symbol(self, word: bytes) -> int:
        return 1 + self.words + crc32(word[-2:]) % self.tail

    def noise(self) -> np.ndarray:
        return (self.mass + 1.0) / (self.mass.sum() + self.symbols)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the lexicon (-1: not known) and symbol of each token."""
        index = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        symbol = self.symbol[index]
        rare = np.flatnonzero(index < 0)
        if len(rare):
            symbol[rare] = [self.tail_symbol(words[k]) for k in rare.tolist()]
        return index, symbol


def lexicon(counts: DataFrame, known: int = KNOWN, words: int = WORDS, tail: int = TAIL) -> Lexicon:
    """Collects the most frequent words (``known`` at most, or ``words`` if that is more) and a few totals; counts: a table
    or checkpoint.

    Words come by whole levels of their count. Only if those that fit are fewer than the symbols, the next level gives
    as many as fit, by the greatest hash.
    """
    known = max(known, words)
    all_words = counts.where("word <> X''")
    # counts by their logarithm: a few hundred rows tell from where on words are at most ``known``
    level = F.floor(F.log2("c") * 32).cast("int")
    levels = sorted(((r.l, r.n) for r in all_words.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n, cut_level = 1 << 30, 0, None
    for at, k in levels:
        if n + k > known:
            cut_level = at
            break
        least, n = at, n + k
    chosen = all_words.where(level >= least)
    if cut_level is not None and n < words:
        edge = all_words.where(level == cut_level).withColumn("_hash", F.xxhash64("word"))
        chosen = chosen.unionByName(top_k(edge, "_hash", "_hash", known - n).select(*all_words.columns))
    found = chosen.toArrow()
    top = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words = min(words, len(top))
    single = {w for w, _ in top[:words]}
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])
    shared = counts.sparkSession.sparkContext.broadcast((single, words, tail))

    def by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, words, tail = shared.value
        own = Lexicon([], words, tail, 0, {}, 0, 0)
        sums = np.zeros((own.symbols, 2), np.int64)
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                sums[0 if not w else own.tail_symbol(w) if w not in single else 1] += (c, 1)
        at = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at, 0]), pa.array(sums[at, 1])], schema=schema)

    total = distinct = ends = 0
    tails = {}
    for r in arrow_map(counts, by_symbol, schema).groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        total, distinct = total + r.n, distinct + r.v
        if r.k == 0:
            ends = r.n
        elif r.k > words:
            tails[r.k] = (r.n, r.v)
    return Lexicon(top, words, tail, ends, tails, total, distinct)


def _laid_out(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts end to end, and the places of their ends."""
    words: list[bytes] = []
    ends = []
    for text in raw_texts(batch):
        words += tokens(text)
        ends.append(len(words))
        words.append(b"")
    return words, np.array(ends, np.int64)


def contexts(symbol: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the second last symbol before each token; before a text's first word stand two ends."""
    one = np.concatenate(([0], symbol[:-1]))
    two = np.concatenate(([0, 0], symbol[:-2]))[: len(symbol)]
    two[ends[:-1] + 1] = 0
    return one, two


def _added(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their values."""
    order = np.argsort(rows.astype(np.int16 if size < 1 << 15 else np.int64), kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], np.add.reduceat(values[order], first, axis=0)


class LogBilinear:
    """Vectors of context symbols, a diagonal matrix for each position, and vectors of predicted symbols, whose last
    number is the bias."""

    SHAPES = ("context", "near", "far", "target")

    def __init__(self, noise: np.ndarray, seed: int = 42):
        """noise: the unigram distribution, which the untrained model predicts nearly."""
        draw = np.random.default_rng(seed)
        n = len(noise)
        p = {"context": draw.normal(0, 0.3, (n, DIM)), "near": np.ones(DIM), "far": np.full(DIM, 0.5), "target": np.column_stack((draw.normal(0, 0.1, (n, DIM)), np.log(noise)))}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.noise = noise

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def set_flat(self, values: np.ndarray) -> LogBilinear:
        at = 0
        for k in self.SHAPES:
            n = self.p[k].size
            self.p[k] = values[at : at + n].astype(np.float32).reshape(self.p[k].shape)
            at += n
        return self

    def scores(self, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The score, not normalised, of each symbol after its context."""
        near, far = self.p["context"] * self.p["near"], self.p["context"] * self.p["far"]
        target, bias = np.ascontiguousarray(self.p["target"][:, :DIM]), self.p["target"][:, DIM]
        out = np.empty(len(symbol), np.float64)
        for at in range(0, len(symbol), SCORED):
            part = slice(at, at + SCORED)
            q = near[one[part]]
            q += far[two[part]]
            out[part] = np.einsum("ij,ij->i", q, target[symbol[part]])
        return out + bias[symbol]

    def normalisers(self, one: int) -> np.ndarray:
        """Log of the sum of all symbols' exponential scores after (two, one), for every symbol two."""
        q = np.ones((len(self.noise), DIM + 1), np.float32)
        q[:, :DIM] = self.p["context"] * self.p["far"] + self.p["context"][one] * self.p["near"]
        target, out = self.p["target"].T.copy(), np.empty(len(q))
        for at in range(0, len(q), 64):  # as much as the processor's cache holds
            scores = q[at : at + 64] @ target
            most = scores.max(1, keepdims=True)
            scores -= most
            np.exp(scores, out=scores)
            out[at : at + 64] = np.log(scores.sum(1)) + most[:, 0]
        return out


class Learner:
    """A model that climbs the noise-contrastive objective by AdaGrad (one rate a vector, one a bias), minibatch after minibatch."""

    def __init__(self, model: LogBilinear, seed: int = 7):
        self.model, self.draw = model, np.random.default_rng(seed)
        self.squares = {k: np.full(v.shape[:1] if v.ndim == 2 else v.shape, 1e-6, np.float32) for k, v in model.p.items()}
        self.squares["bias"] = self.squares["target"].copy()
        self.cumulated = np.cumsum(model.noise)
        self.shift = np.log(NOISE_RATIO * model.noise).astype(np.float32)
        self.seen = 0

    def step(self, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One minibatch: of its tokens and of noise symbols, which stand for NOISE_RATIO noise tokens for each token."""
        p, m = self.model.p, len(symbol)
        drawn = np.minimum(np.searchsorted(self.cumulated, self.draw.random(NOISE)), len(self.shift) - 1)
        both = np.concatenate((symbol, drawn))
        targets = p["target"][both]
        r1, r2 = p["context"][one], p["context"][two]
        q = np.ones((m, DIM + 1), np.float32)  # the bias is the target of a constant
        q[:, :DIM] = r1 * p["near"] + r2 * p["far"]
        # half the log odds that a token is data: its score less its log noise rate
        true = 0.5 * (np.einsum("ij,ij->i", q, targets[:m]) - self.shift[symbol])
        false = 0.5 * (q @ targets[m:].T - self.shift[drawn])
        own = 0.5 - 0.5 * np.tanh(true)
        against = np.tanh(false)
        against += 1
        against *= -0.5 * NOISE_RATIO / NOISE
        dq = own[:, None] * targets[:m] + against @ targets[m:]
        dq = dq[:, :DIM]
        self._climb("target", *_added(both, np.concatenate((own[:, None] * q, against.T @ q)), len(self.shift)))
        steps = _added(np.concatenate((one, two)), np.concatenate((dq * p["near"], dq * p["far"])), len(self.shift))
        for name, own_part in (("near", r1), ("far", r2)):
            self._climb(name, slice(None), np.einsum("ij,ij->j", dq, own_part))
        self._climb("context", *steps)
        self.seen += m

    def _rate(self, name: str, rows, square: np.ndarray) -> np.ndarray:
        squares = self.squares[name]
        squares[rows] += square
        return RATE / np.sqrt(squares[rows])

    def _climb(self, name: str, rows, grad: np.ndarray) -> None:
        table = self.model.p[name]
        if table.ndim == 1:
            table[rows] += self._rate(name, rows, grad * grad) * grad
            return
        vector = grad[:, :DIM]
        step = self._rate(name, rows, np.einsum("ij,ij->i", vector, vector) / DIM)[:, None] * grad
        if name == "target":  # the bias has a rate of its own
            step[:, DIM] = self._rate("bias", rows, grad[:, DIM] ** 2) * grad[:, DIM]
        table[rows] += step

    def learn(self, symbol: np.ndarray, ends: np.ndarray) -> None:
        one, two = contexts(symbol, ends)
        for at in range(0, len(symbol), MINIBATCH):
            part = slice(at, at + MINIBATCH)
            self.step(symbol[part], one[part], two[part])


def train(docs: DataFrame, lex: Lexicon) -> LogBilinear:
    """The average of what all tasks have learnt from their own training texts."""
    model = LogBilinear(lex.noise())
    schema = pa.schema([("task", pa.int64()), ("slot", pa.int32()), ("seen", pa.int64()), ("sums", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(lex)  # at most KNOWN words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = shared.value
        learner = Learner(LogBilinear(own.noise()))
        for batch in slices(batches, BATCH_BYTES):
            words, ends = _laid_out(batch)
            if words:
                learner.learn(own.look_up(words)[1], ends)
        if not learner.seen:
            return
        flat = learner.model.flat().astype(np.float64) * learner.seen
        parts = [flat[at : at + SLOT].tobytes() for at in range(0, len(flat), SLOT)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([learner.seen] * n, pa.int64()), pa.array(parts, pa.binary())], schema=schema)

    def added(rows: pa.Table) -> pa.Table:
        sums = 0
        for x in rows.column("sums").to_pylist():
            sums = sums + np.frombuffer(x, np.float64)
        return pa.table([rows.column(0).slice(0, 1), rows.column(1).slice(0, 1), pa.array([sum(rows.column("seen").to_pylist())], pa.int64()), pa.array([sums.tobytes()], pa.binary())], schema=schema)

    ddl = "task bigint, slot int, seen bigint, sums binary"
    sent = arrow_map(_source(docs).where("not held_out").select("text"), run, schema)
    few = sent.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "slot").applyInArrow(added, ddl)
    found = few.withColumn("task", F.lit(0).cast("bigint")).groupBy("slot").applyInArrow(added, ddl).orderBy("slot").toArrow()  # one model
    if found.num_rows:
        sums = np.concatenate([np.frombuffer(x, np.float64) for x in found["sums"].to_pylist()])
        model.set_flat(sums / found["seen"][0].as_py())
    return model


def normalisers(spark, model: LogBilinear, n: int) -> np.ndarray:
    """The normalisers of all contexts: row one, column two. n squared numbers, whatever the corpus."""
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("one", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            one = batch.column("one")
            yield pa.RecordBatch.from_arrays([one, pa.array([own.normalisers(k).astype(np.float32).tobytes() for k in one.to_pylist()], pa.binary())], schema=schema)

    found = arrow_map(spark.range(0, n, 1, 32).withColumnRenamed("id", "one"), run, schema).toArrow().sort_by("one")
    return np.frombuffer(b"".join(found["z"].to_pylist()), np.float32).reshape(n, n)


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counted", pa.float64()), ("said", pa.float64())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lex, model, normalisers(spark, model, lex.symbols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model, z = shared.value
        size = np.log10(own.sizes)
        plus = np.log10(own.count + 1.0)
        single = np.zeros(own.symbols, bool)
        single[: own.words + 1] = True
        for batch in slices(batches, BATCH_BYTES):
            out: list[list] = [[] for _ in schema]
            words, ends = _laid_out(batch)
            if not words:
                continue
            index, symbol = own.look_up(words)
            one, two = contexts(symbol, ends)
            known = index >= 0
            counted = np.where(known, plus[index], 0.0)  # log10(c + 1)
            said = (model.scores(symbol, one, two) - z[one, two]) / LOG10 + np.where(single[symbol], 0.0, counted - size[symbol])
            starts = np.concatenate(([0], ends[:-1] + 1))
            for k, (row, doc, held) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), strict=True)):
                part = slice(starts[k], ends[k] + 1)
                seen = known[part]
                whole = (row, doc, held, b" %d" % row, None, len(seen), int((seen & (own.count[index[part]] > 0)).sum()), math.fsum(counted[part]), math.fsum(said[part]))
                rare = Counter(words[j] for j in (np.flatnonzero(~seen) + starts[k]).tolist())
                for column, value in zip(out, whole, strict=True):
                    column.append(value)
                n = len(rare)
                for column, values in zip(out, ([row] * n, [None] * n, [None] * n, list(rare), list(rare.values()), *([[None] * n] * 4)), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    # a place in the scan tells rows apart; it is the same when a task runs again. Whole-document rows carry the word
    # " <place>", which no text has, so that they match nothing and spread over the join.
    placed = _source(docs).withColumn("row", F.monotonically_increasing_id())
    sent = arrow_map(placed, run, schema)
    rest = sent.join(counts, "word", "left")
    found = F.col("c").isNotNull()
    sums = rest.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.coalesce(F.max("n_known"), F.lit(0)).alias("n_known"),
        F.sum(F.when(found, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(found, F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("rare"),
        F.max("counted").alias("counted"),
        F.max("said").alias("said"),
    )
    unit = math.log10(lex.total + lex.distinct + 1)
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).cast("bigint").alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("counted") + F.col("rare") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("said") + F.col("rare")).alias("score"),
    )


def train_and_score(docs: DataFrame, known: int = KNOWN, words: int = WORDS, tail: int = TAIL) -> DataFrame:
    counts = cut(word_counts(docs))
    lex = lexicon(counts, known, words, tail)
    return score(docs, counts.where("word <> X''"), lex, train(docs, lex))


def op1_log_bilinear_nce(spark, sf_dir: str) -> DataFrame:
    return train_and_score(read(spark, sf_dir, "documents"))
