"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: pair occurrence index. The distinct words of a batch are laid out as one linked list of symbols; an index maps
each adjacent pair to all its positions. Active ranks are taken in ascending order from a heap, each is applied at all
positions of its pair, and the lists of the pairs that a merge destroys or makes are updated. Every distinct word is
encoded once per worker, however often it occurs.

Scale: one narrow pass without a shuffle; memory is bounded by a slice of a batch and a cache of words. The vocabulary
(a public file of under 2 MB, whatever the corpus) is read by the driver and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lorestack.sources.tables import table

#: Where the vocabulary lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts text into words for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text handled at once, and distinct words kept by a worker.
SLICE_CHARS, CACHE_WORDS = 1 << 20, 1 << 19


class PairIndexEncoder:
    """Byte-pair encoding of many distinct words at once."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_ranks: dict[tuple[int, int], int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall

    def _rank(self, pair: tuple[int, int]) -> int:
        """The id that a pair merges to, -1 if it doesn't."""
        known = self.pair_ranks.get(pair)
        if known is None:
            known = self.pair_ranks[pair] = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], -1)
        return known

    def encode_words(self, words: Iterable[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        words = list(words)
        symbols: list[int] = []
        starts = []
        for word in words:  # a word's symbols lie together, -1 parts it from the next
            starts.append(len(symbols))
            symbols.extend(map(self.byte_ids.__getitem__, word))
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        positions: dict[tuple[int, int], list[int]] = {}
        active: list[tuple[int, int, int]] = []

        def note(i: int, pair: tuple[int, int]) -> None:
            at = positions.get(pair)
            if at is not None:
                at.append(i)
            elif (rank := self._rank(pair)) >= 0:
                positions[pair] = [i]
                heapq.heappush(active, (rank, *pair))

        for i in range(n - 1):
            if symbols[i] >= 0 and symbols[i + 1] >= 0:
                note(i, (symbols[i], symbols[i + 1]))
        while active:
            rank, left, right = heapq.heappop(active)
            for i in sorted(positions.pop((left, right))):
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:  # merged into a neighbour meanwhile
                    continue
                symbols[i], symbols[j] = rank, -2
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if symbols[k] >= 0:
                        note(i, (rank, symbols[k]))
                h = before[i]
                if h >= 0 and symbols[h] >= 0:
                    note(h, (symbols[h], rank))
        out = []
        for start in starts:
            ids, i = [], start
            while symbols[i] >= 0:
                ids.append(symbols[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The cache, which then has all of `words`."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        new = [w for w in words if w not in self.words]
        rest = []
        for word in new:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append((word, raw))
            else:
                self.words[word] = (whole,)
        for (word, _), ids in zip(rest, self.encode_words(raw for _, raw in rest)):
            self.words[word] = ids
        return self.words

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, one after the other; null and empty texts have no ids."""
        ids, offsets = array("i"), [0]
        for part in slices(texts):
            found = [self.find(text) if text else [] for text in part]
            get = self.learn(set(chain.from_iterable(found))).__getitem__
            for words in found:
                ids.extend(chain.from_iterable(map(get, words)))
                offsets.append(len(ids))
        return np.array(offsets, dtype=np.int32), np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        counts = []
        for part in slices(texts):
            found = [self.find(text) if text else [] for text in part]
            get = self.learn(set(chain.from_iterable(found))).__getitem__
            counts.extend(sum(map(len, map(get, words))) for words in found)
        return np.array(counts, dtype=np.int64)


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about SLICE_CHARS characters."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


_encoders: dict[int, PairIndexEncoder] = {}


def _encoder(vocabulary: bytes) -> PairIndexEncoder:
    """The worker's encoder; kept between tasks."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PairIndexEncoder(vocabulary)
    return _encoders[key]


def _with_tokens(df: DataFrame, key: list[str], text: str, vocabulary: str, name: str, count: bool) -> DataFrame:
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([df.schema[k] for k in key] + [T.StructField(name, T.LongType() if count else T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(key)).to_pylist()
            if count:
                out = pa.array(encoder.count_texts(texts))
            else:
                offsets, ids = encoder.encode_texts(texts)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(key))], out], [*key, name])

    return df.select(*key, text).mapInArrow(encode, schema)


def encode_corpus(df: DataFrame, key: list[str], text: str = "text", vocabulary: str = VOCABULARY, name: str = "ids") -> DataFrame:
    """The key columns and `ids`, an array of the token ids of `text`, one row per row of df.

    Without special tokens: their strings in a text are ordinary text. Null and empty texts give an empty array, never
    null; blank texts have the ids of their blanks. Whole texts are encoded, of any length. Repeated rows and null keys
    stay as they are; other columns are not read.
    """
    return _with_tokens(df, key, text, vocabulary, name, False)


def count_tokens(df: DataFrame, key: list[str], text: str = "text", vocabulary: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """Like encode_corpus with the number of ids instead of the ids; 0 for null and empty texts."""
    return _with_tokens(df, key, text, vocabulary, name, True)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), ["doc_id"])


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
