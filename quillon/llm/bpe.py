"""Byte-level BPE by corpus-level merge replay.

The distinct words of a batch of documents are laid out in one flat array of tokens. An inverted index from merge
rank to word positions holds every adjacent pair that the vocabulary can merge. Ranks are taken in ascending order;
one step merges all positions of a rank at once, and only the pairs on either side of a merge are looked up again.
No word is rescanned, so the work follows the number of merges, not words times merges.

The plan is one scan and one map stage without a shuffle: hot sources and copies need no dealing out.

Null text is the empty text (no tokens). Empty tables give an empty result with the same columns. Only the named id and
text columns are read, so further columns of any name do no harm. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spark_ddl, texts

NONE = np.int32(2**31 - 1)
#: Words replayed together hold at most so many bytes (longer single words go alone).
REPLAY_BYTES = 3_000_000
#: Words kept with their ids between batches of one task; on overflow the table starts anew.
KEPT_WORDS = 300_000


#: The pattern that split_all() follows without a regular expression (fixed value; others go through the regex library).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents are split together up to about so many characters.
SPLIT_CHARS = 1_000_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point, as the regex library classes them."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split_all(documents: list[str], kinds: np.ndarray) -> list[list[str]]:
    """What SPLIT finds in each document, from the kinds of neighbouring characters.

    A run of one kind is a word. A plain space before a run of another kind belongs to it; of several white-space
    characters all but the last form a word of their own, except at the end of a text, where all do. An apostrophe
    that begins a word takes the ending s, t, m, d, re, ve or ll that follows.
    """
    text = "".join(documents)
    n = len(text)
    if not n:
        return [[] for _ in documents]
    char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[char]
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    stops = np.cumsum(lengths)
    first = np.zeros(n + 1, bool)  # a document begins here
    first[0] = first[n] = True
    first[stops] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    plain = char == 32
    start = run[:n].copy()
    # the last white-space character before a run begins a word; a plain one takes the run with it
    next_run = ~space
    next_run[1:] &= space[:-1] & ~first[1:n]
    next_run[0] = False
    at = np.flatnonzero(next_run)
    start[at - 1] = True
    start[at[plain[at - 1]]] = False
    for i in np.flatnonzero((char == 39) & start & (kind == OTHER)).tolist():
        m = ENDINGS.match(text, i + 1, min(i + 3, int(stops[np.searchsorted(stops, i, "right")])))
        if m:
            start[i + 1] = False
            if m.end() < n and kind[m.end()] == LETTER:
                start[m.end()] = True
    begin = np.flatnonzero(start)
    counts = np.searchsorted(begin, stops).tolist()
    ends = [*begin[1:].tolist(), n]
    words = [text[a:b] for a, b in zip(begin.tolist(), ends, strict=True)]
    return [words[a:b] for a, b in zip([0, *counts[:-1]], counts, strict=True)]


ENDINGS = regex.compile("s|t|re|ve|m|ll|d")


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes -> id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.pattern = pattern
        self.words = regex.compile(pattern)
        self.kinds = kinds() if pattern == SPLIT else None
        self.single = np.full(256, -1, np.int32)
        for i in range(256):
            self.single[i] = ranks[bytes([i])]
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the pair cannot merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def split(self, documents: list[str]) -> list[list[str]]:
        """The matches of the pattern in each document."""
        if self.kinds is None:
            return [self.words.findall(x) for x in documents]
        out: list[list[str]] = []
        group, size = [], 0
        for x in documents:
            group.append(x)
            size += len(x)
            if size > SPLIT_CHARS:
                out += split_all(group, self.kinds)
                group, size = [], 0
        return out + split_all(group, self.kinds)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """For each word (not empty) its ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        token = self.single[flat]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = n
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - lengths] = -1
        alive, head = np.ones(n, bool), np.zeros(n, bool)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.merged(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(positions: np.ndarray) -> None:
            """Puts positions into the index below the rank of the pair that begins there."""
            r = rank[positions]
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            positions, r = positions[: (last := np.searchsorted(r, NONE))], r[:last]
            if not last:
                return
            cuts = np.flatnonzero(np.diff(r)) + 1
            for k, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if k not in index:
                    index[k] = []
                    heapq.heappush(queue, k)
                index[k].append(part)

        file(inner)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = np.sort(at[rank[at] == r])
            if not len(at):
                continue
            if len(parts) > 1:  # a position may have been filed twice
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            touching = after[at[:-1]] == at[1:]
            if touching.any():  # as in "aaa": from the left, every second one of a run
                start = np.maximum.accumulate(np.where(np.concatenate(([False], touching)), 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            token[at] = r
            alive[gone] = False
            rank[gone] = NONE
            following = after[gone]
            after[at] = following
            inside = following < n
            before[following[inside]] = at[inside]
            rank[at] = NONE
            heads = at[inside]
            lead = before[at]
            lead = lead[lead >= 0]
            head[heads] = True
            touched = np.concatenate((heads, lead[~head[lead]]))
            head[heads] = False
            if len(touched):
                rank[touched] = self.merged(token[touched], token[after[touched]])
                file(touched)
        counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64)
        ids, stops = token[alive].astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_all(self, documents: list[str], kept: dict[str, bytes]) -> Iterator[bytes]:
        """The ids of each document, as bytes; kept: words known so far."""
        split = self.split(documents)
        new = list(set().union(*split) - kept.keys())
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list(set().union(*split))
        at = 0
        while at < len(new):
            group, size = [], 0
            while at + len(group) < len(new) and (not group or size < REPLAY_BYTES):
                group.append(new[at + len(group)].encode("utf-8", "surrogatepass"))
                size += len(group[-1])
            kept.update(zip(new[at : at + len(group)], self.replay(group), strict=True))
            at += len(group)
        for words in split:
            yield b"".join(map(kept.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text], {})), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary a Python worker, read from a file that every node has installed."""
    return Vocabulary.load(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, their count and digests, and whether the decoded bytes equal the text."""
    own = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own[0], pattern or own[1]
    schema = pa.schema([f for f in RESULT if with_ids or f.name != "token_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, kept = vocabulary(path, pattern), {}
        for batch in slices(batches):
            columns: dict[str, list] = {f.name: [] for f in RESULT}
            columns["doc_id"] = batch.column("doc_id").to_pylist()
            documents = texts(batch)
            for text, ids in zip(documents, vocab.encode_all(documents, kept), strict=True):
                numbers = np.frombuffer(ids, "<u4")
                decoded = vocab.decode(numbers.tolist())
                columns["n_tokens"].append(len(numbers))
                columns["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                columns["round_trip"].append(decoded == text.encode("utf-8", "surrogatepass"))
                if with_ids:
                    columns["token_ids"].append(numbers.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, spark_ddl(schema))


def op7_bpe_merge_replay(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    from .common import read

    return encode_documents(read(spark, sf_dir, "documents"), with_ids=False)
