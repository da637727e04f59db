"""Words of many texts at once, as 64-bit hashes, by NumPy over their UTF-8 bytes.

Word classes are sets of bytes: every byte from 0x80 up belongs to a word, so a class never
splits a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_class(separators: Iterable[int]) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


#: `[^\x20\x09-\x0D]+`
BY_SPACE = word_class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased: letters, digits, non-ASCII
ALNUM = word_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LANE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Lanes:
    """Spans of bytes as 64-bit numbers, eight bytes each, the last filled up with zeros; `first[i]` is where span i's begin."""

    values: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray


def lanes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lanes:
    size = end - start
    count = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(count) - count
    view = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw.tobytes() + bytes(8), strides=(1,))
    if not len(count) or count.max() == 1:
        return Lanes(view[start] & _KEEP[np.minimum(size, 8)], first, count, size)
    done = 8 * (np.arange(int(count.sum())) - np.repeat(first, count))
    values = view[np.repeat(start, count) + done] & _KEEP[np.minimum(np.repeat(size, count) - done, 8)]
    return Lanes(values, first, count, size)


def hash_lanes(x: Lanes) -> np.ndarray:
    """A 64-bit hash of each span: each lane is mixed, then mixed with its place, and only then added up, so that no
    algebra of the bytes survives (a polynomial modulo 2 ** 64 gives the Thue-Morse word and its complement one hash)."""
    if not len(x.size):
        return np.zeros(0, dtype=np.uint64)
    one = mix(x.values)
    if len(one) > len(x.first):
        place = np.arange(len(one)) - np.repeat(x.first, x.count)
        one = one + place.astype(np.uint64) * _LANE
        one = np.add.reduceat(mix(one), x.first)
    else:
        one = mix(one)
    return mix(one + x.size.astype(np.uint64) * _LENGTH)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]."""
    return hash_lanes(lanes(raw, start, end))


@dataclass
class Words:
    """Words in order; `first[d]:first[d + 1]` are those of text d; `start`/`end` are bytes in `data`."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    base: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def scan(texts: list[str | None], mask: np.ndarray, lower: bool = True) -> Words:
    """All words of `texts`; None is empty. Equal words have equal hashes whatever text they are in."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    base = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=base[1:])
    raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    inside = mask[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    hashes = hash_spans(raw, start, end)
    first = np.searchsorted(start, base, side="left")
    return Words(raw.tobytes(), start, end, hashes, first, base)


_STEP = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and the text of each; a text with fewer words but some gives one of them all."""
    h, first = words.hash, words.first
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = first[owner] + offset
    acc = np.full(len(owner), k, dtype=np.uint64)
    short = np.repeat(n < k, count)
    length = np.where(short, n[owner], k)
    for j in range(k):
        live = j < length
        acc = acc * _STEP[j % 5] + np.where(live, h[np.minimum(at + j, len(h) - 1)] if len(h) else 0, np.uint64(7)).astype(np.uint64)
        acc = acc ^ (acc >> np.uint64(29))
    return mix(acc), owner


def batches(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, one text at least."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]
