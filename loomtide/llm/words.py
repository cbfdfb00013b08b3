"""Words of whole texts as numpy arrays: many texts are laid end to end in one byte buffer and handled together.

All classes of characters used here are told apart by ASCII bytes, so work on UTF-8 bytes is exact. A word gets a
64-bit polynomial hash of its bytes; hashes of windows are built from the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text handled together. A longer text is a group of its own; its words are hashed in pieces of this size.
GROUP_BYTES = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
SALT = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Bytes of words separated by ASCII white space, and of words of digits, letters and all characters beyond ASCII.
NOT_BLANK = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

PLAIN = mixed(np.arange(1, 257, dtype=np.uint64))
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]


@dataclass
class Words:
    """Words of a group of texts, in order. ``text`` numbers the text of each word within the group."""

    buffer: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.text_start)

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        found = np.bincount(self.text, weights=weights, minlength=self.n_texts)
        return found.astype(np.int64)

    def first(self) -> np.ndarray:
        """Position of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    up = down = powers(BASE, 0)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + GROUP_BYTES, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        if len(up) < b - a + 1:
            up, down = powers(BASE, b - a + 1), powers(BASE_INVERSE, b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(codes[buffer[a:b]] * up[: b - a], out=sums[1:])
        at = start[i:j] - a
        out[i:j] = (sums[end[i:j] - a] - sums[at]) * down[at]
        i = j
    return mixed(out)


def spans(buffer: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a class; the buffer begins and ends outside of it."""
    edges = np.flatnonzero(np.diff(inside[buffer].view(np.int8))) + 1
    return edges[0::2], edges[1::2]


def groups(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled together."""
    lo = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > lo and size + n > GROUP_BYTES:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list, inside: np.ndarray = NOT_BLANK, fold: bool = True) -> Words:
    """Words of some texts; ``None`` has none. ``fold``: A-Z hash like a-z."""
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    buffer = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)
    text_end = np.cumsum(sizes + 1)
    text_start = text_end - sizes
    start, end = spans(buffer, inside)
    first = np.searchsorted(start, np.append(text_start, len(buffer)))
    return Words(
        buffer, text_start, text_end, start, end,
        np.repeat(np.arange(len(parts)), np.diff(first)),
        hash_spans(buffer, start, end, FOLDED if fold else PLAIN),
    )


def window_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, over the borders of texts as well."""
    out = word_hash[: max(0, len(word_hash) - n + 1)].copy()
    for k in range(1, n):
        out = out * STEP + word_hash[k : len(word_hash) - n + 1 + k]
    return mixed(out)


def inside_text(text: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words stay within one text."""
    return text[: max(0, len(text) - n + 1)] == text[n - 1 :]


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the runs of n words that begin at the given positions."""
    edge = np.bincount(at, minlength=n_words + 1) - np.bincount(at + n, minlength=n_words + 1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return among(keys, twice)


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array; a bitmap of their low bits rules most others out."""
    out = np.zeros(len(keys), dtype=bool)
    if len(ordered):
        low = np.zeros(1 << 16, dtype=bool)
        low[ordered & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(low[keys & np.uint64(0xFFFF)])
        near = np.minimum(np.searchsorted(ordered, keys[at]), len(ordered) - 1)
        out[at] = ordered[near] == keys[at]
    return out


def in_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that differ from text to text."""
    return mixed(keys + text.astype(np.uint64) * SALT)
