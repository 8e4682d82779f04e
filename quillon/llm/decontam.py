"""Benchmark decontamination: BM25 over the test items with block-max WAND, then verified overlap.

Statistics (item count, mean length, document frequencies) are those of the whole benchmark. Its items are cut into
index shards of at most SHARD_ITEMS items and SHARD_BYTES bytes of text, SCAN_SHARDS of which are broadcast to one scan
of the documents; so what a worker holds is bounded however large the benchmark grows, and a document is read and taken
apart once for every SCAN_SHARDS shards. Within a shard, items of similar length form a tier, so one very long item
doesn't widen the windows of all. For a tier a document is cut into windows of three segments, each of half the tier's
longest item and overlapping by two, so each place of an item lies whole in some window. Each window is a query: all
items whose share of their own greatest score reaches ``threshold`` are retrieved.

Block-max WAND skips exactly: a window whose terms' upper bounds stay below the threshold in every block has no pivot,
and a pivot whose block maxima stay below it is passed over. Block maxima are kept for the blocks that have a term only;
terms of more than WIDE blocks add their greatest maximum to a window's bound for all blocks at once. Retrieved items
are verified on word 5-grams: of all the item's, at least ``overlap`` must occur in the window, and of its question part
and its answer part at least ``part_overlap`` each. The question ends with the item's last question mark, or else in its
middle.

Documents are never shuffled. Null texts and texts without words have no hits; items without words are left out; items
of fewer than five words count as one n-gram. Repeated rows give repeated results; repeated items each count. Empty
tables give empty results. Only id and text columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, read, slices, texts

K1, B = 1.5, 0.75
GRAM = 5
#: Bounds of one index shard; shards that one scan of the documents meets.
SHARD_ITEMS, SHARD_BYTES, SCAN_SHARDS = 20_000, 8 << 20, 4
#: Items in a block; blocks beyond which a term counts as being in all; words of the longest items of the first tier.
BLOCK, WIDE, SHORT = 4, 256, 64
#: Words whose postings a worker keeps as lists.
READ = 4096
#: Numbers in one table of window bounds.
BOUNDS = 2_000_000
THRESHOLD, OVERLAP, PART_OVERLAP = 0.65, 0.8, 0.5
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Statistics:
    """What BM25 knows of the whole benchmark. Held on the driver: its distinct words."""

    def __init__(self, items: Iterator[str]):
        self.n, words, self.df = 0, 0, Counter()
        for text in items:
            if own := tokens(text):
                self.n += 1
                words += len(own)
                self.df.update(set(own))
        self.mean = words / max(1, self.n)

    def idf(self, word: str) -> float:
        n = self.df[word]
        return math.log(1 + (self.n - n + 0.5) / (n + 0.5))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + counts[i] of all i, end to end."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Index:
    """BM25 inverted index of items; impacts are shares of the item's score for its own words, so all lie in 0 to 1.

    Words, items and blocks are numbers; what belongs to a word lies together in flat arrays, between two of its starts.
    """

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None):
        stats = stats or Statistics(t for _, t in items)
        split = [(i, t, w) for i, t in items if (w := tokens(t))]
        # similar items share blocks, which makes the blocks' bounds tight: by commonest word, then by length
        split.sort(key=lambda x: (max(x[2], key=lambda w: (stats.df[w], w)), len(x[2]), x[0]))
        self.ids = [i for i, _, _ in split]
        self.longest = max((len(w) for _, _, w in split), default=0)
        self.row: dict[str, int] = {}  # numbers of words, from 1; 0 is any other word
        self.words = [np.fromiter((self.row.setdefault(x, len(self.row) + 1) for x in w), np.int32, len(w)) for _, _, w in split]
        self.asked = [self._question(t, len(w)) for _, t, w in split]
        lengths = np.array([len(w) for w in self.words], np.int64)
        n, rows = max(1, len(split)), len(self.row) + 1
        flat = np.concatenate([np.zeros(0, np.int32), *self.words]).astype(np.int64) * n + np.repeat(np.arange(len(split)), lengths)
        pairs, tf = np.unique(flat, return_counts=True)
        word, self.items = np.divmod(pairs, n)
        idf = np.array([0.0, *map(stats.idf, self.row)])
        norm = K1 * (1 - B + B * lengths / max(stats.mean, 1e-9))
        weights = idf[word] * tf / (tf + norm[self.items])
        self.impacts = weights / np.bincount(self.items, weights, n)[self.items]
        self.items = self.items.astype(np.int32)
        self.starts = np.searchsorted(word, np.arange(rows + 1))
        self.blocks = -(-len(split) // BLOCK)
        key = word * max(1, self.blocks) + self.items // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.peaks = np.maximum.reduceat(self.impacts, first).astype(np.float32) if len(first) else np.zeros(0, np.float32)
        self.peak_block = (key[first] % max(1, self.blocks)).astype(np.int32)
        self.peak_starts = np.searchsorted(word[first], np.arange(rows + 1))
        count = np.diff(self.peak_starts)
        self._read: dict[int, tuple[list[int], list[float]]] = {}  # postings of words looked at, as lists
        self.wide = np.zeros(rows, np.float32)
        for k in np.flatnonzero(count > WIDE).tolist():
            self.wide[k] = self.peaks[self.peak_starts[k] : self.peak_starts[k + 1]].max()

    @staticmethod
    def _question(text: str, n: int) -> int:
        """Words of the question part."""
        last = text.rfind("?")
        words = len(tokens(text[: last + 1])) if last >= 0 else 0
        return words if 0 < words < n else n // 2

    def posting(self, row: int) -> tuple[list[int], list[float]]:
        """The items that have a word, in ascending order, and their impacts."""
        if row not in self._read:
            if len(self._read) >= READ:
                self._read.clear()
            part = slice(self.starts[row], self.starts[row + 1])
            self._read[row] = self.items[part].tolist(), self.impacts[part].tolist()
        return self._read[row]

    def _peaks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of peaks, and the places of all, of each of the rows."""
        counts = self.peak_starts[rows + 1] - self.peak_starts[rows]
        return counts, _ranges(self.peak_starts[rows], counts)

    def search(self, rows: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for distinct term rows, by block-max WAND.

        Blocks are aligned, so the sum of the terms' block maxima bounds every item of a block: blocks below the
        threshold are skipped whole. Within a block the cursors are kept by item, and the pivot is the first at which
        the block maxima so far reach the threshold; cursors before it move up to it unseen.
        """
        found: list[tuple[int, float]] = []
        enough = threshold - 1e-9
        counts, places = self._peaks(rows)
        block_of, owner = self.peak_block[places], np.repeat(rows, counts)
        sums = np.bincount(block_of, self.peaks[places], max(1, self.blocks))
        able = np.flatnonzero(sums >= threshold - 1e-3)
        if not len(able):
            return found
        for block in able.tolist():
            stop = (block + 1) * BLOCK
            cursors = []  # item, place, peak, items, impacts
            here = np.flatnonzero(block_of == block)
            for row, peak in zip(owner[here].tolist(), self.peaks[places[here]].tolist(), strict=True):
                items, impacts = self.posting(row)
                at = bisect_left(items, block * BLOCK)
                cursors.append([items[at], at, peak + 1e-7, items, impacts])
            while True:
                cursors.sort(key=itemgetter(0))
                reach, pivot = 0.0, -1
                for c in cursors:
                    reach += c[2]
                    if reach >= enough:
                        pivot = c[0]
                        break
                if pivot < 0:
                    break
                score = math.fsum(c[4][c[1]] for c in cursors if c[0] == pivot) if cursors[0][0] == pivot else 0.0
                if score >= enough:
                    found.append((pivot, score))
                bar = pivot + (cursors[0][0] == pivot)  # the first item not yet decided
                for c in cursors:
                    if c[0] < bar:
                        c[1] = at = bisect_left(c[3], bar, c[1])
                        c[0] = c[3][at] if at < len(c[3]) else stop
                cursors = [c for c in cursors if c[0] < stop]
        return found

    def verify(self, item: int, window: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's n-grams, of its question's and its answer's, that occur in a window of word numbers."""
        own, text = self.words[item].tolist(), window.tolist()
        width = min(GRAM, len(own))
        there = set(zip(*(text[i:] for i in range(width)), strict=False))
        hits = [g in there for g in zip(*(own[i:] for i in range(width)), strict=False)]
        question, answer = hits[: self.asked[item]], hits[self.asked[item] :]
        share = lambda x: sum(x) / len(x) if x else sum(hits) / len(hits)
        return share(hits), share(question), share(answer)

    def able_windows(self, rows: np.ndarray, stride: int, threshold: float) -> list[int]:
        """Starts of the windows of three segments whose bounds reach the threshold in some block."""
        segments = max(1, -(-len(rows) // stride))
        windows = max(1, segments - 2)
        at = np.flatnonzero(rows)
        segment, term = at // stride, rows[at]
        base = np.concatenate((np.bincount(segment, self.wide[term], segments), [0, 0]))
        base = base[:windows] + base[1 : windows + 1] + base[2 : windows + 2]
        some = self.wide[term] == 0
        segment, term = segment[some], term[some]
        out: list[int] = []
        step = max(1, BOUNDS // max(1, self.blocks) - 2)
        for begin in range(0, windows, step):
            end = min(windows, begin + step)
            part = slice(*np.searchsorted(segment, [begin, end + 2]))
            counts, places = self._peaks(term[part])
            key = np.repeat(segment[part] - begin, counts) * self.blocks + self.peak_block[places]
            sums = np.bincount(key, self.peaks[places], (end - begin + 2) * self.blocks).reshape(-1, self.blocks)
            most = (sums[:-2] + sums[1:-1] + sums[2:]).max(1)
            maybe = np.flatnonzero(most[: end - begin] + base[begin:end] >= threshold - 1e-3) + begin
            out += maybe[self._reaches(rows, maybe * stride, 3 * stride, threshold)].tolist() if len(maybe) else []
        return [k * stride for k in out]

    def _reaches(self, rows: np.ndarray, starts: np.ndarray, size: int, threshold: float) -> np.ndarray:
        """Whether the distinct words of a window at each of the starts reach the threshold in some block."""
        lengths = np.minimum(size, len(rows) - starts)
        word = rows[_ranges(starts, lengths)]
        key = (np.repeat(np.arange(len(starts)), lengths) * (len(self.row) + 1) + word)[word > 0]
        window, term = np.divmod(np.unique(key), len(self.row) + 1)
        counts, places = self._peaks(term)
        sums = np.bincount(np.repeat(window, counts) * self.blocks + self.peak_block[places], self.peaks[places], len(starts) * self.blocks)
        return sums.reshape(-1, self.blocks).max(1) >= threshold - 1e-3

    def hits(self, words: list[str], threshold: float, overlap: float, part_overlap: float) -> dict[int, tuple[float, float, float, float]]:
        """item -> best (overlap, question, answer, score) of the verified items in a document of these words."""
        if not self.ids or not words:
            return {}
        stride = max(GRAM, -(-self.longest // 2))
        rows = np.fromiter(map(self.row.get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple[float, float, float, float]] = {}
        for at in self.able_windows(rows, stride, threshold):
            window = rows[at : at + 3 * stride]
            distinct = np.unique(window)
            for item, score in self.search(distinct[distinct > 0], threshold):
                shares = self.verify(item, window)
                if shares[0] >= overlap and min(shares[1:]) >= part_overlap:
                    best[item] = max(best.get(item, (0.0,)), (*shares, score))
        return best


def tiers(items: list[tuple[int, str]], stats: Statistics) -> list[Index]:
    """The items by length: of up to SHORT words, up to twice as many, and so on."""
    by: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for i, t in items:
        if n := len(tokens(t)):
            by[max(0, (n - 1).bit_length() - (SHORT - 1).bit_length())].append((i, t))
    return [Index(by[k], stats) for k in sorted(by)]


def index_shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in groups within the bounds, one at a time on the driver."""
    group: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        if group and (len(group) >= SHARD_ITEMS or size + len(row.t) > SHARD_BYTES):
            yield group
            group, size = [], 0
        group.append((row.i, row.t))
        size += len(row.t)
    yield group


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): each document's verified items."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = Statistics(t for group in index_shards(benchmark) for _, t in group)
    send = docs.sparkSession.sparkContext.broadcast

    def scanned(shards: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [index for shard in shards for index in shard.value]
            for batch in slices(batches):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    words = tokens(text)
                    for index in indexes:
                        for k, (all_, question, answer, score) in sorted(index.hits(words, threshold, overlap, part_overlap).items()):
                            rows.append((doc, index.ids[k], score, all_, question, answer))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(HITS), HITS, strict=True)], schema=HITS)

        return arrow_map(source, run, HITS)

    out, held = None, []
    for items in index_shards(benchmark):
        held.append(send(tiers(items, stats)))  # within the bounds of a shard
        if len(held) == SCAN_SHARDS:
            out, held = scanned(held) if out is None else out.unionByName(scanned(held)), []
    if held:
        out = scanned(held) if out is None else out.unionByName(scanned(held))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified item; all columns stay. Rows of one id stay or go together."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["_hit"]), "left_anti")


def op2_bm25_wand_decontamination(spark, sf_dir: str) -> DataFrame:
    """The verified benchmark items of every document of the corpus."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
