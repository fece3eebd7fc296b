"""Hashes of all words of a run of texts at once.

A word is a run of letters a-z (A-Z lower-cased), digits and bytes beyond ASCII. Its hash is the
polynomial of its bytes modulo 2^64, taken from prefix sums over the whole run, and then mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Word bytes as they are (A-Z lower-cased), all others a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    found = np.ones(1, np.uint64)
    while len(found) < size:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
    return found[:size]


def _powers_up_to(base: int, n: int) -> np.ndarray:
    size = 1 << 19
    while size < n:
        size *= 2
    return _powers(base, size)


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mixed polynomial hash of values[start:end] for each span; order matters, place does not."""
    up, down = _powers_up_to(_BASE, len(values) + 1), _powers_up_to(_INVERSE, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: hashes, byte spans in `raw` (the texts joined by newlines), and edges.

    Words edges[i]:edges[i + 1] belong to text i, whose bytes begin at begins[i].
    """

    def __init__(self, texts: list[str]) -> None:
        coded = [t.encode() for t in texts]
        self.raw = b"\n".join(coded) + b"\n"
        self.bytes = np.frombuffer(self.raw.translate(WORD_BYTES), np.uint8)
        sizes = np.array([len(c) + 1 for c in coded], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        inside = np.concatenate([[False], self.bytes != 32, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = spans_hashed(self.bytes, self.starts, self.ends) if len(edge) else np.zeros(0, np.uint64)
        self.edges = np.searchsorted(self.starts, np.append(self.begins, len(self.raw)))


def text_runs(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in runs of about size characters, or one longer text."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > size:
            yield start, texts[start:i]
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, texts[start:]


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for every `width` consecutive words; for fewer words, one for all; for none, none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(max(1, n - width + 1))
    return spans_hashed(hashes, starts, np.minimum(starts + width, n))
