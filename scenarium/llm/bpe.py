"""Encoding with a public byte-level BPE tokenizer, by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can be merged by no rule: between the two,
every encoding has a boundary. Such cuts are found for a whole batch of texts at once by looking up byte pairs in a
table. The pieces are encoded independently, each distinct piece once per worker's cache, and their ids are put together again.

The tokenizer splits a text by a pattern before it merges. A forced cut is only used where the pattern agrees, i.e. gives
the two sides the same tokens it gives the whole: not within a character, not after white space (which the pattern
joins to what follows), and not before an apostrophe (which could begin a contraction on the right side that the whole
has not). A longer text is therefore never a longer unit of work.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are: a parameter of every function, this is its default.
FOLDER = os.environ.get("SCENARIUM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern of the public tokenizer that texts are split by before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a vocabulary's file at most, as it is broadcast.
MOST_BYTES = 32 << 20
#: Pieces a worker remembers; beyond it starts anew.
CACHE_PIECES = 200_000
#: Longer pieces are not remembered.
CACHE_BYTES = 64


class Encoder:
    """One vocabulary in one process; ``lines``: the file of its tokens and ranks."""

    def __init__(self, name: str, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines())}
        self.whole = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.forced = np.ones(1 << 16, dtype=bool)
        for token in self.ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            self.forced[b[:-1] << 8 | b[1:]] = False
        self.cache: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places k where ``data`` (UTF-8) is cut between k - 1 and k."""
        if len(data) < 2:
            return np.empty(0, dtype=np.int64)
        left, right = data[:-1], data[1:]
        ok = self.forced[left.astype(np.int32) << 8 | right]
        ok &= (right & 0xC0) != 0x80  # within a character
        ok &= right != 0x27
        ok &= ~(((left >= 0x09) & (left <= 0x0D)) | ((left >= 0x1C) & (left <= 0x20)))
        ok &= ~_wide_space_ends(data)[:-1]
        return np.flatnonzero(ok) + 1

    def piece(self, b: bytes) -> list[int]:
        ids = self.cache.get(b)
        if ids is None:
            ids = self.whole.encode_ordinary(b.decode("utf-8", "surrogatepass"))
            if len(b) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[b] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        return self._join(raw, self.cuts(np.frombuffer(raw, dtype=np.uint8)).tolist())

    def _join(self, raw: bytes, cuts: list[int]) -> list[int]:
        out: list[int] = []
        at, get = 0, self.cache.get
        for k in cuts:
            b = raw[at:k]
            at = k
            out += get(b) or self.piece(b)
        if at < len(raw):
            out += self.piece(raw[at:])
        return out

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a string array; null gives an empty list."""
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            raw = text.as_buffer() if text.is_valid else None
            if raw is not None and raw.size:
                data = np.frombuffer(raw, dtype=np.uint8)
                got = self._join(raw.to_pybytes(), self.cuts(data).tolist())
                ids.append(np.array(got, dtype=np.int32))
                lengths[i + 1] = len(got)
        flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat, pa.int32()))


def _wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Where a white space character of more than one byte ends."""
    n = len(data)
    one = np.zeros(n, dtype=np.uint8)
    two = np.zeros(n, dtype=np.uint8)
    one[1:], two[2:] = data[:-1], data[:-2]
    wide = (one == 0xC2) & ((data == 0x85) | (data == 0xA0))
    wide |= (two == 0xE1) & (one == 0x9A) & (data == 0x80)
    wide |= (two == 0xE2) & (one == 0x80) & (((data >= 0x80) & (data <= 0x8A)) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    wide |= (two == 0xE2) & (one == 0x81) & (data == 0x9F)
    wide |= (two == 0xE3) & (one == 0x80) & (data == 0x80)
    return wide


def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> bytes:
    """The vocabulary's file, read where the driver is; workers get it by broadcast and need no folder of their own."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        lines = f.read(MOST_BYTES + 1)
    if len(lines) > MOST_BYTES:
        raise ValueError(f"{name}: more than {MOST_BYTES} bytes")
    return lines


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY, lines: bytes | None = None) -> Encoder:
    """The process's own encoder, made once per worker."""
    return Encoder(name, vocabulary(name=name) if lines is None else lines)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list. Other columns are not read. Repeated rows give as many rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, lines.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # ids of some texts at a time
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode_batch(part.column(1))], [key, "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, size BIGINT): the number of tokens; zero for null and empty texts."""
    kind = docs.schema[key].dataType.simpleString()
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, lines.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = enc.encode_batch(part.column(1)).value_lengths().cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n], [key, "size"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, size bigint")
