"""Token counts by byte-pair merging with a heap over a linked list of symbols.

A word starts as one symbol a byte. The heap holds the mergeable adjacent pairs by (rank, place); popping
the lowest merges it, relinks its neighbours and pushes the two pairs that come to stand beside it.
A pair that no longer stands as it was pushed is skipped. The count of a word is its initial symbols less
its merges: no identifiers are made.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map, batch_of, texts_of
from ._pieces import Vocabulary, WordTable, runs


def pair_ranks(merges: list[tuple[int, int, int]]) -> tuple[dict[int, int], list[int]]:
    """Rank << 32 by left << 24 | right, and the symbol that each rank makes."""
    return {a << 24 | b: r << 32 for r, (a, b, _) in reversed(list(enumerate(merges)))}, [made for *_, made in merges]


def merges_of(word: bytes, start: list[int], rank: dict[int, int], made: list[int]) -> tuple[int, list[int]]:
    """The number of merges in a word, and its symbols by place (-1 where one has been merged away).

    A heap entry is rank << 32 | place, so that entries compare as (rank, place).
    """
    symbols = [start[b] for b in word]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap, i = [], 0
    for key in [a << 24 | b for a, b in zip(symbols, symbols[1:])]:
        if (r := rank.get(key)) is not None:
            heap.append(r | i)
        i += 1
    heapify(heap)
    merged = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if j >= n or (left := symbols[i]) < 0 or (r := rank.get(left << 24 | symbols[j])) is None or r != entry - i:
            continue
        symbols[i], symbols[j] = new, _ = made[entry >> 32], -1
        merged += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(new << 24 | symbols[k])) is not None:
                heappush(heap, r | i)
        h = before[i]
        if h >= 0 and (r := rank.get(symbols[h] << 24 | new)) is not None:
            heappush(heap, r | h)
    return merged, symbols


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.start = [v.ids[bytes([b])] for b in range(256)]
        self.rank, self.made = pair_ranks(v.merges)
        self.table = WordTable(self._counts)

    def count_word(self, word: bytes) -> int:
        return len(word) - merges_of(word, self.start, self.rank, self.made)[0] if len(word) > 1 else len(word)

    def _counts(self, words: list[str | bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        counts = [1 if isinstance(w, int) else self.count_word(w.encode() if isinstance(w, str) else w) for w in words]
        return np.zeros(0, "<u4"), np.array(counts, np.int64)

    def count(self, texts: list[str]) -> list[int]:
        return [n for run in runs(texts) for n in self.table.counts([self.vocabulary.words(t) for t in run])]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process and file."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of docs.

    Only doc_id and text are read, so other columns may have any name. A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows give repeated results, a null doc_id stays null, an empty table gives
    no rows. Special strings inside a text count as one token, as in the library's default.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch)
        counts = counter(tokenizer).count(texts)
        yield batch_of({"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}, {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
