"""Byte-level BPE by replaying the merges over a corpus of different words.

The text is cut by the tokenizer's pattern.  The different words of a block of documents form a
small corpus: their bytes lie in one list of symbols, and an inverted index lists for every adjacent
pair the positions where it stands.  The merges are applied to the whole corpus in rank order; each
one visits only the positions of its pair and touches only the two neighbours.  Words of earlier
blocks of the same task are kept, up to ``keep_words``, and need no replay.

Null text counts as empty: no tokens.  Empty tables give empty results, repeated rows equal rows.
Memory is bounded by a portion of an Arrow batch of about ``PORTION`` characters or the longest text, the
kept words and the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import portions

KEEP_WORDS = 200_000
PORTION = 2_000_000


class Vocabulary:
    """Ranks of byte strings: ``symbols[id]`` are the bytes of a token.

    ``pairs`` (sorted, left token * 2^32 + right token) and ``made`` list every pair that makes a
    token.  ``early`` marks tokens that stand in a pair which makes a token of lower rank.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.symbols = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = [
            (left << 32 | right, made)
            for token, made in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.made = table[:, 0].copy(), table[:, 1].copy()
        self.early = np.zeros(max(self.symbols) + 1, dtype=bool)
        for part in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            self.early[part[self.made < part]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pairs make a token; their keys; the tokens."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = np.flatnonzero((self.pairs[at] == keys) & (left >= 0) & (right >= 0))
        return hit, keys[hit], self.made[at[hit]]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Corpus:
    """Symbols of many words as a linked list, with an inverted index from pair to positions."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(word) for word in words], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1)
        # Separators, -1, stand in front of and behind every word; no merge crosses them.
        self.symbol = np.full(len(raw) + len(words) + 1, -1, dtype=np.int64)
        inside = np.ones(len(self.symbol), dtype=bool)
        inside[0] = False
        inside[self.ends] = False
        self.symbol[inside] = vocabulary.bytes[raw]
        self.after = np.arange(1, len(self.symbol) + 1)
        self.before = np.arange(-1, len(self.symbol) - 1)
        self.index: dict[int, list[np.ndarray]] = {}
        self.queue: list[tuple[int, int]] = []
        self.enter(np.arange(len(self.symbol) - 1))

    def enter(self, at: np.ndarray) -> None:
        """Lists the pairs that begin at these positions and make a token."""
        hit, keys, made = self.vocabulary.look_up(self.symbol[at], self.symbol[self.after[at]])
        if not len(hit):
            return
        order = np.argsort(keys, kind="stable")
        keys, made, at = keys[order], made[order], at[hit[order]]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        stops = np.append(starts[1:], len(keys)).tolist()
        for key, token, start, stop in zip(keys[starts].tolist(), made[starts].tolist(), starts.tolist(), stops):
            places = self.index.get(key)
            if places is None:
                self.index[key] = [at[start:stop]]
                heapq.heappush(self.queue, (token, key))
            else:
                places.append(at[start:stop])

    def join(self, at: np.ndarray, token: int) -> None:
        """Merges the pairs that begin at these positions, of which no two overlap."""
        other = self.after[at]
        behind = self.after[other]
        self.symbol[at], self.symbol[other] = token, -2
        self.after[at] = behind
        self.before[behind] = at
        ahead = self.before[at]
        self.enter(np.concatenate((ahead, at)))

    def standing(self, key: int, at: np.ndarray) -> np.ndarray:
        """The positions where the pair still stands, ascending."""
        at = np.unique(at)
        at = at[self.symbol[at] == key >> 32]
        at = at[self.symbol[self.after[at]] == key & 0xFFFFFFFF]
        if key >> 32 == key & 0xFFFFFFFF and len(at) > 1:
            # Of overlapping pairs of one symbol every second goes, from the left.
            linked = np.concatenate(([False], self.after[at[:-1]] == at[1:]))
            place = np.arange(len(at))
            run = place - np.maximum.accumulate(np.where(linked, 0, place))
            at = at[run % 2 == 0]
        return at

    def replay(self) -> None:
        """Applies the merges in rank order."""
        while self.queue:
            token, key = heapq.heappop(self.queue)
            shared = bool(self.queue) and self.queue[0][0] == token
            if not shared and not self.vocabulary.early[token]:
                at = self.standing(key, np.concatenate(self.index.pop(key)))
                if len(at):
                    self.join(at, token)
                continue
            # Pairs that make the same token compete, and some merges bring up an earlier one: then
            # the leftmost position goes first and the rest waits for its turn.
            keys = [key]
            while self.queue and self.queue[0][0] == token:
                keys.append(heapq.heappop(self.queue)[1])
            places = {k: self.standing(k, np.concatenate(self.index.pop(k))) for k in keys}
            left = np.concatenate(list(places.values()))
            if not len(left):
                continue
            word = np.searchsorted(self.ends, left)
            order = np.lexsort((left, word))
            first = np.concatenate(([True], word[order][1:] != word[order][:-1]))
            self.join(left[order[first]], token)
            self.enter(left[order[~first]])

    def tokens(self) -> Iterator[np.ndarray]:
        """The tokens of every word."""
        kept = np.flatnonzero(self.symbol >= 0)
        cuts = np.searchsorted(kept, self.ends)
        return iter(np.split(self.symbol[kept], cuts[:-1])) if len(self.ends) else iter(())


def replay(words: list[bytes], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """The tokens of every word, by merges in rank order over all words together."""
    corpus = Corpus(words, vocabulary)
    corpus.replay()
    return corpus.tokens()


def encode_batches(
    batches: Iterable[list[str]], path: str, pattern: str, keep_words: int = KEEP_WORDS
) -> Iterator[list[bytes]]:
    """Token ids of every text as little-endian unsigned 32-bit integers."""
    split = regex.compile(pattern)
    table = vocabulary(path)
    known: dict[str, bytes] = {}
    for texts in batches:
        out: list[bytes] = []
        for part in portions(texts, PORTION):
            cut = [split.findall(text) for text in part]
            different = set().union(*cut)
            if len(known) > keep_words:
                known.clear()
            new = [word for word in different if word not in known]
            tokens = replay([word.encode("utf-8") for word in new], table)
            known.update((word, ids.astype("<u4").tobytes()) for word, ids in zip(new, tokens))
            out.extend(b"".join(map(known.__getitem__, words)) for words in cut)
        yield out


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes that a sequence of little-endian token ids stands for."""
    return b"".join(map(vocabulary(path).symbols.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def encode(
    documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        held: list[pa.Array] = []

        def texts():
            for batch in batches:
                held.append(batch.column(0))
                yield _texts(batch.column(1))

        for ids in encode_batches(texts(), path, pattern):
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([held.pop(0), counts, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Key and ``decoded`` (the bytes) of every encoded row."""
    source = encoded.select(F.col(key).alias("key"), "ids")

    def run(batches):
        for batch in batches:
            made = [decode_ids(ids, path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "decoded"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def digest_round_trip(
    documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes decoded from them, without moving either."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        held: list[pa.Array] = []

        def texts():
            for batch in batches:
                held.append(batch.column(0))
                yield _texts(batch.column(1))

        for ids in encode_batches(texts(), path, pattern):
            columns = [
                held.pop(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
