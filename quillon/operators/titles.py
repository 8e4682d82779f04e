"""Which numbered titles of a document are accepted: each one that follows the last accepted one.

Whether a title is accepted depends on all before it, but only through the last accepted number. So a document's titles
are cut into runs, and a run is summed up by what it makes of a number that is current where it begins: the first of its
titles that follows that number is accepted, and from there on the run's own titles decide. Such maps compose, whatever
their order of evaluation. The numbers that can be current at a run's beginning are those with which some run can end;
they are few, as chains of accepted titles soon meet.

So the scan over runs (see ``scan``) decides documents of any size, each in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.store import written
from . import scan

#: Comparisons held at once; numbers whose comparisons a task remembers.
COMPARED, REMEMBERED = 1 << 22, 1 << 13


def numbers(section_ids: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of titles like "4.2" as rows of one width, and how many of a row are its own."""
    parts = [[min(int(x), 1 << 40) for x in s.split(".") if x.isascii() and x.isdigit()] for s in section_ids]
    out = np.zeros((len(parts), max(map(len, parts), default=0) or 1), np.int64)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out, np.array([len(p) for p in parts], np.int64)


def follows(new: Sequence[str], current: Sequence[str], jump: int) -> np.ndarray:
    """Whether each new number may come after each current one; any may after the empty one, none after one without
    numbers. Otherwise it grows by 1 to ``jump`` at the first level that differs or goes deeper than all of the current
    one, and levels that open below lie in 1 to ``jump``."""
    a, n = numbers(new)
    b, m = numbers(current)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    levels, free = np.arange(width), np.array([s == "" for s in current])
    out = np.empty((len(a), len(b)), bool)
    step = max(1, COMPARED // max(1, len(b) * width))
    for at in range(0, len(a), step):
        x, k = a[at : at + step, None, :], n[at : at + step, None]
        shared = (x == b) & (levels < np.minimum(k, m)[:, :, None])
        same = np.cumprod(shared, axis=2).sum(axis=2)
        inner = same < m
        first = np.minimum(same, width - 1)[:, :, None]
        grown = (np.take_along_axis(np.broadcast_to(x, shared.shape), first, 2) - np.take_along_axis(np.broadcast_to(b, shared.shape), first, 2))[:, :, 0]
        opened = (levels >= (same + inner)[:, :, None]) & (levels < k[:, :, None])
        fits = np.where(opened, (x >= 1) & (x <= jump), True).all(axis=2)
        ok = (same < k) & (~inner | (grown >= 1) & (grown <= jump)) & fits & (m > 0)
        out[at : at + step] = ok | free
    return out


class _Known:
    """Which of the numbers met so far follow which: a task compares each pair once."""

    def __init__(self, jump: int):
        self.jump, self.names, self.at, self.table = jump, [], {}, np.zeros((0, 0), bool)

    def places(self, section_ids: Sequence[str]) -> np.ndarray:
        new = [s for s in dict.fromkeys(section_ids) if s not in self.at]
        if len(self.names) + len(new) > REMEMBERED:  # what was known is given up
            self.names, self.at, new = [], {}, list(dict.fromkeys(section_ids))
            self.table = np.zeros((0, 0), bool)
        if new:
            old = len(self.names)
            self.names += new
            self.at |= {s: old + i for i, s in enumerate(new)}
            table = np.empty((len(self.names),) * 2, bool)
            table[:old, :old] = self.table
            table[old:, :] = follows(new, self.names, self.jump)
            table[:old, old:] = follows(self.names[:old], new, self.jump)
            self.table = table
        return np.array([self.at[s] for s in section_ids], np.int64)


def summed_up(section_ids: Sequence[str], known: _Known) -> tuple[list[str], list[str]]:
    """The distinct numbers of a run by their first places, and with which number the run ends if that place is the first
    to be accepted."""
    at = known.places(section_ids)
    distinct, own = np.unique(at, return_inverse=True)
    table = known.table[np.ix_(distinct, distinct)]
    following = np.full(len(distinct), -1)  # by current number, the next place that follows it
    ends, first = np.empty(len(own), np.int64), np.empty(len(distinct), np.int64)
    for j in range(len(own) - 1, -1, -1):
        v = own[j]
        ends[j] = v if following[v] < 0 else ends[following[v]]
        following[table[v]] = j
        first[v] = j
    order = np.sort(first)
    names = [known.names[i] for i in distinct]
    return [names[own[j]] for j in order], [names[ends[j]] for j in order]


def decided(section_ids: Sequence[str], begin: str, known: _Known) -> tuple[list[bool], list[str]]:
    """Whether each title of a run is accepted, and the number that is current with it."""
    at = known.places([begin, *section_ids])
    now, table, out, current = at[0], known.table, [], []
    for x in at[1:].tolist():
        ok = bool(table[x, now])
        now = x if ok else now
        out.append(ok)
        current.append(known.names[now])
    return out, current


def runs(titles: DataFrame, order: list[str], jump: int) -> DataFrame:
    """(doc_id, run, t, names, ends): the titles in runs, with what sums them up."""
    rows = titles.select("doc_id", *order, F.coalesce("section_id", F.lit("")).alias("section_id"))

    def sum_up():
        known = _Known(jump)

        def of(batch: pa.RecordBatch):
            sections = batch.column("section_id").to_pylist()
            return lambda a, b: summed_up(sections[a:b], known)

        return of

    strings = ArrayType(StringType())
    return scan.in_runs(rows, "doc_id", order, [StructField("names", strings), StructField("ends", strings)], sum_up)


def maps(found: DataFrame, jump: int) -> DataFrame:
    """(doc_id, run, numbers, map) of documents with several runs: what each run makes of each number that can be current
    at its beginning, as places in ``numbers``; the first of these is the empty one, with which documents begin."""
    ends = found.select("doc_id", "run", F.explode(F.array_distinct("ends")).alias("end")).groupBy("doc_id", "end").agg(F.min("run").alias("a"), F.max("run").alias("b"))
    can = ends.groupBy("doc_id").agg(F.array_sort(F.array_remove(F.collect_list("end"), "")).alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("a < b")
    can = can.select(F.col("doc_id").alias("_doc"), F.concat(F.array(F.lit("")), "n").alias("numbers"))
    rows = found.select("doc_id", "run", "names", "ends").join(can, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    schema = StructType([found.schema["doc_id"], StructField("run", LongType()), StructField("numbers", ArrayType(StringType())), StructField("map", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for names, ends_, can_be in zip(*(batch.column(c).to_pylist() for c in ("names", "ends", "numbers")), strict=True):
                place = {s: i for i, s in enumerate(can_be)}
                table = follows(names, can_be, jump)
                first = table.argmax(axis=0)
                out.append([place[ends_[j]] if table[j, e] else e for e, j in enumerate(first.tolist())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "run", "numbers")), pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def accepted_titles(titles: DataFrame, order: list[str], jump: int = 5) -> DataFrame:
    """(doc_id, order..., section_id, accepted, current): whether each title of a document, in order, follows the last
    accepted one, and the number that is current with it. Titles at one place are in any order; a null number is empty."""
    found = written(runs(titles, order, jump))
    mapped = maps(found, jump)
    begun = found.select("doc_id", "run", "t").join(mapped.select("run", "numbers"), "run", "left").join(scan.entry_states(mapped, "doc_id"), "run", "left")
    begun = begun.select("doc_id", "t", F.get("numbers", "entry").alias("begin"))
    item = found.schema["t"].dataType.elementType
    flagged = StructType([found.schema["doc_id"], StructField("t", ArrayType(item)), StructField("accepted", ArrayType(BooleanType())), StructField("current", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(jump)
        for batch in batches:
            if batch.num_rows:
                t = batch.column("t")
                flags, current = zip(*(decided(s, b or "", known) for s, b in zip(scan.unpacked(t, "section_id"), batch.column("begin").to_pylist(), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), t, pa.array(list(flags), pa.list_(pa.bool_())), pa.array(list(current), pa.list_(pa.string()))], names=flagged.names)

    each = begun.mapInArrow(run, flagged).select("doc_id", F.explode(F.arrays_zip("t", "accepted", "current")).alias("x"))
    return each.select("doc_id", *(F.col(f"x.t.{c}").alias(c) for c in [*order, "section_id"]), F.col("x.accepted").alias("accepted"), F.col("x.current").alias("current"))
