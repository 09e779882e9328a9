"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

A text is cut into pieces by the vocabulary's own pattern. A piece's bytes are
merged pair by pair, always the leftmost pair of the lowest rank. A segment tree
over the byte positions holds the leftmost minimum rank, so that a merge costs
two logarithmic point updates of live neighbours, and a piece of n bytes
O(n log n) however long it is. Pieces recur, so each Python worker remembers the
ids of those it has met, in a table of bounded size that only saves time.

Texts are encoded whole, in Arrow batches without a shuffle. Defined cases: null
and empty texts give an empty list; strings of special tokens are ordinary text;
rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

VOCABULARY = os.environ.get("BEACONRY_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public pre-tokenizer pattern of this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker, each at most so many bytes.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
NONE = 1 << 60


@functools.cache
def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MinTree:
    """Leftmost minimum over positions under point updates."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        self.values = values + [NONE] * (size - len(values))
        self.where = [0] * size + list(range(size))
        for k in range(size - 1, 0, -1):
            self.where[k] = self._better(self.where[2 * k], self.where[2 * k + 1])

    def _better(self, left: int, right: int) -> int:
        return right if self.values[right] < self.values[left] else left

    def update(self, at: int, value: int) -> None:
        values, where = self.values, self.where
        values[at] = value
        k = (at + self.size) >> 1
        while k:
            left, right = where[2 * k], where[2 * k + 1]
            where[k] = right if values[right] < values[left] else left
            k >>= 1

    def least(self) -> tuple[int, int]:
        at = self.where[1]
        return at, self.values[at]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    # Part i spans piece[i:end[i]]; live parts are linked by end and start_before.
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = lambda i, j: ranks.get(piece[i:j], NONE)
    tree = MinTree([rank(i, i + 2) for i in range(n - 1)])
    while True:
        at, lowest = tree.least()
        if lowest >= NONE:
            break
        gone = end[at]
        end[at] = end[gone]
        tree.update(at, rank(at, end[end[at]]) if end[at] < n else NONE)
        if gone < n - 1:
            tree.update(gone, NONE)
        if end[at] < n:
            before[end[at]] = at
        if before[at] >= 0:
            tree.update(before[at], rank(before[at], end[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Encoder:
    def __init__(self, path: str):
        self.ranks = load(path)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.pattern.findall(text):
            found = known.get(piece)
            if found is None:
                data = piece.encode("utf-8")
                found = merge(data, self.ranks)
                if len(data) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every document."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pd.Series([own.encode(x) for x in batch], dtype=object)

    return documents.select(key, ids(F.col(text)).alias("ids"))
