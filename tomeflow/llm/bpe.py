"""BPE encoding by speculating and verifying, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is the word's encoding exactly when each of
its tokens encodes to itself and no merge could cross a border between two neighbours. For a border, the
symbols beside it are at any time a node on the right edge of the left token's merge tree and one on the
left edge of the right token's; their merge happens if its rank comes before the one that takes the left
node into its parent, and not after the one that takes the right node (on equal rank the left pair goes
first). All borders of a block of words are tested at once with numpy, walking both edges down from the
roots. Words with a border that fails are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map, batch_of, texts_of
from ._pieces import Vocabulary, WordTable, runs
from .token_counts import merges_of, pair_ranks

_NEVER = np.int64(1 << 60)


class SpeculativeCodec:
    """Encodes and decodes whole texts; `speculated` and `exact` count the distinct words of either way."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.start = [v.ids[bytes([b])] for b in range(256)]
        self.rank, self.made = pair_ranks(v.merges)
        keys = np.array([a * v.size + b for a, b, _ in v.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._born = np.full(v.size, -1, np.int64)
        self._left = np.arange(v.size)
        self._right = np.arange(v.size)
        for r, (a, b, made) in reversed(list(enumerate(v.merges))):  # the first merge that makes a token counts
            self._born[made], self._left[made], self._right[made] = r, a, b
        made = np.array(sorted({m for *_, m in v.merges}), np.int64)
        whole = np.ones(v.size, bool)
        whole[made] = ~self._crossed(self._left[made], self._right[made], roots=False)
        for m in made[np.argsort(self._born[made])].tolist():  # children come first
            whole[m] &= whole[self._left[m]] & whole[self._right[m]]
        self._match = {t: i for t, i in v.ids.items() if whole[i]}
        self._longest: dict[bytes, int] = {}
        for t in self._match:
            self._longest[t[:2]] = max(self._longest.get(t[:2], 0), len(t))
        self.speculated = self.exact = 0
        self.table = WordTable(self._encode_new)
        self._text_of = [str(i) for i in range(v.size)]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.vocabulary.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def _crossed(self, left: np.ndarray, right: np.ndarray, roots: bool = True) -> np.ndarray:
        """Whether a merge crosses the border of each pair of tokens; roots: the two themselves may merge."""
        crossed = np.zeros(len(left), bool)
        a, b = left.astype(np.int64), right.astype(np.int64)
        limit_a, limit_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        live, first = np.arange(len(a)), True
        while len(live):
            if not first or roots:
                rank = self._rank_of(a, b)
                hit = (rank < limit_a) & (rank <= limit_b) & (rank != _NEVER)
                crossed[live[hit]] = True
            else:
                hit = np.zeros(len(a), bool)
            first = False
            go = ~hit & ((self._born[a] >= 0) | (self._born[b] >= 0))
            live, a, b, limit_a, limit_b = live[go], a[go], b[go], limit_a[go], limit_b[go]
            down_a, down_b = self._born[a] >= self._born[b], self._born[b] >= self._born[a]
            limit_a, limit_b = np.where(down_a, self._born[a], limit_a), np.where(down_b, self._born[b], limit_b)
            a, b = np.where(down_a, self._right[a], a), np.where(down_b, self._left[b], b)
        return crossed

    def _propose(self, word: bytes) -> list[int]:
        match, longest = self._match, self._longest
        found, i, n = [], 0, len(word)
        if (whole := match.get(word)) is not None:
            return [whole]
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := match.get(word[i:j])) is not None:
                    found.append(t)
                    i = j
                    break
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self._propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        border = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(flat[border] * self.vocabulary.size + flat[border + 1], return_inverse=True)
        failed = np.unique(of[border[self._crossed(pairs // self.vocabulary.size, pairs % self.vocabulary.size)[back]]])
        for k in failed.tolist():
            proposed[k] = [s for s in merges_of(words[k], self.start, self.rank, self.made)[1] if s >= 0]
        self.speculated, self.exact = self.speculated + len(words) - len(failed), self.exact + len(failed)
        return proposed

    def _encode_new(self, words: list[str | bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_words([b"" if isinstance(w, int) else w.encode() if isinstance(w, str) else w for w in words])
        found = [[w] if isinstance(w, int) else x for w, x in zip(words, ids, strict=True)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((t for x in found for t in x), "<u4", int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for run in runs(texts):
            yield from self.table.ids([self.vocabulary.words(t) for t in run])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self._text_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeCodec:
    """One for each worker process and file."""
    return SpeculativeCodec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row of docs.

    Null texts encode as empty (no ids). Null or repeated doc_ids, extra columns and empty tables change
    nothing: each row is encoded on its own from doc_id and text.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [x.tobytes() for x in codec(tokenizer).encode(texts_of(batch))]
        yield batch_of({"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}, {"n_tokens": pa.int64(), "ids": pa.binary()})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of what encode() gave; null ids decode to an empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it = codec(tokenizer)
        texts = [it.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
        yield batch_of({"doc_id": batch.column(0), "text": texts}, {"text": pa.string()})

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes every whole text, decodes its ids again and digests both, in one pass over a worker's codec.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded text in UTF-8). Nulls and repeats as in encode().
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        it, n, of_ids, of_text = codec(tokenizer), [], [], []
        for found in it.encode(texts_of(batch)):
            ids = found.tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(it.listed(ids).encode()).hexdigest())
            of_text.append(hashlib.sha256(it.decode(ids).encode()).hexdigest())
        yield batch_of({"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
