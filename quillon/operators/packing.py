"""Where groups of paragraphs begin, for any number of paragraphs under one heading.

A group takes paragraphs while its token estimate stays within a limit; estimates grow with the words, so a group that
begins at one paragraph ends where the prefix sum of the words first exceeds its own by more than the limit's words: a
binary search. From each place there is one next beginning, and a chain of them. A second chain, over the groups, joins
those below a least size with their successors.

What a run of paragraphs does hangs only on the words held by the group that is open where it begins, and a group holds
few: as many words as fit the limit, or one paragraph above it. So both chains are scans over runs (see ``scan``) with
few states, and the paragraphs of one heading lie in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.store import delete, scratch, written
from . import scan


def estimate(words: int, per_word: float) -> int:
    """As the column expression: at least one, halves to even."""
    return max(1, round(words * per_word))


def most_words(limit: float, per_word: float, strict: bool = False) -> int:
    """The most words whose estimate is within the limit (below it, if strict); -1 if there are none."""
    if per_word <= 0:
        raise ValueError("words must have tokens")
    fits = lambda n: estimate(n, per_word) < limit if strict else estimate(n, per_word) <= limit
    low, high = -1, max(1, int(limit / per_word) + 2)
    while fits(high):
        high *= 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def _segments(fresh: np.ndarray) -> np.ndarray:
    """By place, up to one behind the last, the next place at or after it where a segment begins (or the number of rows)."""
    n, begins = len(fresh), np.append(np.flatnonzero(fresh), len(fresh))
    return begins[np.searchsorted(begins, np.arange(n + 1))]


@dataclass(frozen=True)
class Filling:
    """The first chain. States: 0, nothing is open; 1 + w, a group of w words is open; the last, one that takes no more."""

    most: int

    @property
    def states(self) -> int:
        return self.most + 3

    def next_places(self, sums: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """By place of a group's beginning the place of the next; the number of rows stands for none in this run."""
        over = np.searchsorted(sums, sums[:-1] + self.most, side="right") - 1
        return np.minimum(np.maximum(over, np.arange(1, len(fresh) + 1)), _segments(fresh)[1:])

    def first_places(self, entries: np.ndarray, sums: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The first place where a group begins, by the state in which the run is entered."""
        over = np.searchsorted(sums, self.most - (entries - 1), side="right") - 1
        open_ = (entries > 0) & (entries < self.states - 1)
        return np.where(open_, np.minimum(np.maximum(over, 0), _segments(fresh)[0]), 0)

    def left(self, last: np.ndarray, entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The state behind the run if its last group begins at ``last``, or none does (the number of rows)."""
        n = len(sums) - 1
        words = np.where(last < n, sums[n] - sums[last], entries - 1 + sums[n])
        state = 1 + np.minimum(words, self.most + 1)
        return np.where((last < n) | (entries > 0) & (entries < self.states - 1), state, entries)


@dataclass(frozen=True)
class Joining:
    """The second chain, over groups. States: 0, the next group begins a chunk; 1 + w, a chunk of w words waits for it."""

    least: int  # the most words that are still too few

    @property
    def states(self) -> int:
        return self.least + 2

    def next_places(self, sums: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """A chunk ends with the first group that brings it above ``least``, or with its segment."""
        full = np.searchsorted(sums, sums[:-1] + self.least, side="right")
        return np.minimum(np.maximum(full, np.arange(1, len(fresh) + 1)), _segments(fresh)[1:])

    def first_places(self, entries: np.ndarray, sums: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        full = np.searchsorted(sums, self.least - (entries - 1), side="right")
        return np.where(entries > 0, np.minimum(np.maximum(full, 1), _segments(fresh)[0]), 0)

    def left(self, last: np.ndarray, entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
        n = len(sums) - 1
        words = np.where(last < n, sums[n] - sums[last], entries - 1 + sums[n])
        return np.where((words <= self.least) & ((last < n) | (entries > 0)), 1 + words, 0)


def _sums(words: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.array(words, np.int64)))).astype(np.int64)


def run_map(chain: Filling | Joining, words: list[int], fresh: list[bool], closed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each state in which a run can be entered: that in which it is left, the last place where a group begins (-1:
    nowhere), and in how many. closed: a title ends the run."""
    sums, new, entries = _sums(words), np.array(fresh, bool), np.arange(chain.states)
    n = len(new)
    if not n:
        return entries * (not closed), np.full(len(entries), -1), entries * 0
    following = chain.next_places(sums, new).tolist()
    last, count = list(range(n + 1)), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        last[i] = i if following[i] == n else last[following[i]]
        count[i] = 1 + count[following[i]]
    first = chain.first_places(entries, sums, new)
    ends = np.array(last)[first]
    return entries * 0 if closed else chain.left(ends, entries, sums), np.where(first < n, ends, -1), np.array(count)[first]


def places(chain: Filling | Joining, words: list[int], fresh: list[bool], entry: int) -> list[int]:
    """By row of a run the place where its group begins, -1 before the first."""
    sums, new = _sums(words), np.array(fresh, bool)
    out, following = np.full(len(new), -1), chain.next_places(sums, new).tolist()
    at = int(chain.first_places(np.array([entry]), sums, new)[0])
    while at < len(new):
        out[at : following[at]] = at
        at = following[at]
    return out.tolist()


def chained(chain: Filling | Joining, rows: DataFrame, at: str, folder: str) -> DataFrame:
    """(doc_id, at, words, start, number, fresh) of the rows that are no titles: where the row's group begins, the group's
    number in the document from 1, and whether the row opens a segment.

    rows: (doc_id, at, words, title, key, opens): the order, the row's words, whether it is a title, which begins a segment
    and belongs to no group, what begins a segment where it changes, and whether the row does so by itself. The rows are
    written to ``folder`` between the steps, without any texts.
    """
    key = rows.schema["key"].dataType
    fields = [StructField("words", ArrayType(LongType())), StructField("fresh", ArrayType(BooleanType())), StructField("places", ArrayType(LongType())), StructField("first", key), StructField("last", key), StructField("title_first", BooleanType()), StructField("closed", BooleanType())]

    def sum_up():
        def of(batch: pa.RecordBatch):
            words, titles, opens, ats, keys = (batch.column(c).to_pylist() for c in ("words", "title", "opens", at, "key"))

            def of_run(a: int, b: int) -> tuple:
                kept, fresh, where, new = [], [], [], False
                for i in range(a, b):
                    new = new or titles[i] or opens[i] or (i > a and keys[i] != keys[i - 1])
                    if not titles[i]:
                        kept.append(words[i])
                        fresh.append(bool(new))
                        where.append(ats[i])
                        new = False
                return kept, fresh, where, keys[a], keys[b - 1], bool(titles[a]), bool(titles[b - 1])

            return of_run

        return of

    found = written(scan.in_runs(rows.select("doc_id", F.col(at).cast("bigint").alias(at), F.col("words").cast("bigint").alias("words"), "title", "key", "opens"), "doc_id", [at], fields, sum_up).drop("t"), f"{folder}/runs")
    earlier = Window.partitionBy("doc_id").orderBy("run")
    before = F.lag(F.struct("last", "closed")).over(earlier)
    narrow = found.select("doc_id", "run", "first", "last", "closed", "title_first")
    # a run's first row opens a segment by what came before it
    alone = F.lag("run").over(earlier).isNull() & F.lead("run").over(earlier).isNull()
    opening = narrow.select("run", alone.alias("alone"), (~F.col("title_first") & (before.isNull() | before["closed"] | ~before["last"].eqNullSafe(F.col("first")))).alias("opens"))
    held = found.select("doc_id", "run", "words", "fresh", "places", "closed").join(opening, "run")
    mapped_type = StructType([found.schema["doc_id"], StructField("run", LongType()), StructField("map", ArrayType(IntegerType())), StructField("lasts", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))])

    def opened(fresh: list[bool], opens: bool) -> list[bool]:
        return [True, *fresh[1:]] if opens and fresh else fresh

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, lasts, counts = [], [], []
            for words, fresh, where, closed, opens in zip(*(batch.column(c).to_pylist() for c in ("words", "fresh", "places", "closed", "opens")), strict=True):
                left, last, count = run_map(chain, words, opened(fresh, opens), closed)
                maps.append(left.tolist())
                lasts.append([where[i] if i >= 0 else None for i in last.tolist()])
                counts.append(count.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("run"), pa.array(maps, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=mapped_type.names)

    mapped = written(held.where(~F.col("alone")).mapInArrow(summed, mapped_type), f"{folder}/maps")  # a document of one run needs no map
    entered = mapped.join(scan.entry_states(mapped, "doc_id"), "run").select("doc_id", "run", "entry", F.get("lasts", "entry").alias("last"), F.get("counts", "entry").alias("n"))
    so_far = earlier.rowsBetween(Window.unboundedPreceding, -1)
    entries = entered.select("run", "entry", F.last("last", ignorenulls=True).over(so_far).alias("carried"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    out_type = StructType([found.schema["doc_id"], *(StructField(n, LongType()) for n in (at, "words", "start", "number")), StructField("fresh", BooleanType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("words", "fresh", "places", "opens", "entry", "carried", "before")]
            source, out = [], [[] for _ in range(5)]
            for i, (words, fresh, where, opens, entry, carried, before) in enumerate(zip(*columns, strict=True)):
                own = opened(fresh, opens)
                begins = places(chain, words, own, entry)
                number = np.cumsum([p == k for k, p in enumerate(begins)]) + before
                source.extend([i] * len(words))
                for column, more in zip(out, (where, words, [where[p] if p >= 0 else carried for p in begins], number.tolist(), own), strict=True):
                    column.extend(more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.bool_())], names=out_type.names)

    known = held.join(entries, "run", "left").withColumn("entry", F.coalesce("entry", F.lit(0))).withColumn("before", F.coalesce("before", F.lit(0)))
    return known.mapInArrow(placed, out_type)


def packed(rows: DataFrame, max_tokens: int, min_tokens: int, per_word: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, idx, chunk) of paragraphs, and (doc_id, chunk, opens) of chunks, which are numbered from 1 in a document;
    opens: the chunk is the first of its segment.

    rows: (doc_id, idx, words, title, key). A group takes paragraphs while its estimate stays within max_tokens; one below
    min_tokens joins the next, unless it is the last of its segment.
    """
    def settled(chain: Filling | Joining, rows: DataFrame, at: str) -> DataFrame:
        folder = scratch(rows.sparkSession)
        out = written(chained(chain, rows, at, folder))
        delete(rows.sparkSession, folder)  # what is behind the written rows isn't needed again
        return out

    filled = settled(Filling(most_words(max_tokens, per_word)), rows.withColumn("opens", F.lit(False)), "idx")
    groups = filled.groupBy("doc_id", "start").agg(F.sum("words").alias("words"), F.max(F.col("fresh") & (F.col("idx") == F.col("start"))).alias("opens"))
    chain = Joining(max(-1, most_words(min_tokens, per_word, strict=True)))
    joined = settled(chain, groups.withColumn("key", F.lit(0)).withColumn("title", F.lit(False)).withColumnRenamed("start", "at"), "at")
    chunks = joined.groupBy("doc_id", F.col("number").alias("chunk")).agg(F.max("fresh").alias("opens"))
    named = joined.select(F.col("doc_id").alias("_doc"), F.col("at").alias("_start"), F.col("number").alias("chunk"))
    placed = filled.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("start") == F.col("_start")))
    return placed.select("doc_id", "idx", "chunk"), chunks
