"""Words of whole texts, as byte-level BPE tokenizers split them, and tables of what words encode to.

Merges stay inside words, and the words of a corpus repeat, so each worker encodes a word once and then
looks it up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np

#: The tokenizers' split pattern for text below U+0250, with its letters, numbers and white space spelled out.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    found = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [found[b] for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, in bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        back = {c: b for b, c in enumerate(byte_characters())}
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in added}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (map(as_bytes, p) for p in pairs)]
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._path, self._split = path, None

    def words(self, text: str) -> list[str | bytes | int]:
        """The words that merges stay inside of (str, or bytes where the library's splitter was needed), and
        special strings as their ids."""
        if self._at_special is None or not any(x in text for x in self.special):
            return self._plain(text)
        found: list[str | bytes | int] = []
        for k, part in enumerate(self._at_special.split(text)):
            found += [self.special[part]] if k % 2 else self._plain(part)
        return found

    def _plain(self, text: str) -> list[str] | list[bytes]:
        if BEYOND_LATIN.search(text) is None:
            return _LATIN_WORDS.findall(text)
        if self._split is None:  # the library's own splitter knows its Unicode version
            from tokenizers import Tokenizer

            self._split, self._back = Tokenizer.from_file(self._path).pre_tokenizer, {c: b for b, c in enumerate(byte_characters())}
        return [bytes(map(self._back.__getitem__, word)) for word, _ in self._split.pre_tokenize_str(text)]


class Numbers(dict):
    """Numbers words as they are first asked for; new holds those since it was last cleared."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word: object) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTable:
    """The ids of each distinct word, computed once and looked up by number.

    It is emptied when it holds more than `limit` words or about `chars` characters, which bounds its memory.
    """

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, chars: int = 12_000_000) -> None:
        self._encode_new, self._limit, self._most = encode_new, limit, chars
        self._reset()

    def _reset(self) -> None:
        self._numbers, self._chars = Numbers(), 0
        self._flat, self._begin, self._size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._known = self._used = 0

    def _learn(self) -> None:
        new = self._numbers.new
        if not new:
            return
        ids, sizes = self._encode_new(new)
        n = self._known + len(new)
        while n > len(self._begin):
            self._begin, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._begin, self._size))
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + len(ids)] = ids
        self._begin[self._known : n], self._size[self._known : n] = self._used + np.cumsum(sizes) - sizes, sizes
        self._known, self._used = n, self._used + len(ids)
        self._chars += 4 * int(sizes.sum())  # four to a token
        new.clear()

    def _numbered(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all words, running ends of their ids, where each text begins and the last ends)."""
        if len(self._numbers) > self._limit or self._chars > self._most:
            self._reset()
        number = self._numbers.__getitem__
        words = [np.fromiter(map(number, t), np.int64, len(t)) for t in texts]
        self._learn()
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        ends = np.cumsum(self._size[flat])
        return flat, ends, np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]

    def ids(self, texts: list[list]) -> list[np.ndarray]:
        """The ids of each text, given its words."""
        flat, ends, edges = self._numbered(texts)
        size = self._size[flat]
        ids = self._flat[np.arange(int(edges[-1])) + np.repeat(self._begin[flat] - ends + size, size)]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def counts(self, texts: list[list]) -> list[int]:
        """The number of ids of each text; for tables whose encode_new gives sizes and no ids."""
        return np.diff(self._numbered(texts)[2]).tolist()


def runs(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """texts in runs of about size characters, or one longer text."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if run and chars + len(text) > size:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run
