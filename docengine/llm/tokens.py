"""Byte-level BPE of many texts at once: NumPy finds pre-tokens, each distinct one is encoded once by the tokenizers library.

A text whose characters are ASCII without apostrophes, or U+00C0 to U+00FF letters, has pre-tokens that follow
from byte classes. Other texts are split by the library's own rules (`_odd`). Either way the ids
are those of encoding the whole text, as a pre-token's ids do not depend on its neighbours.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

from docengine.llm import words as W

_SPACE, _LETTER, _DIGIT, _MARK = 0, 1, 2, 3
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_KNOWN = 1_500_000


def byte_alphabet() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    out = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(out[b] for b in range(256))


def plain(text: bytes) -> bool:
    """Whether byte classes give the pre-tokens."""
    if b"'" in text or b"<|" in text:
        return False
    if text.isascii():
        return True
    raw = np.frombuffer(text, dtype=np.uint8)
    lead = np.flatnonzero(raw >= 0xC0)
    if (raw[lead] != 0xC3).any() or np.count_nonzero(raw >= 0x80) != 2 * len(lead):
        return False
    follow = raw[lead + 1]
    return not ((follow == 0x97) | (follow == 0xB7)).any()


class Known:
    """Ids of the pre-tokens met so far, found by a 64-bit hash and told apart by their bytes."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        # of each entry: hash, where its ids and its lanes are, how many ids, how many bytes; sorted by hash
        self.entries = tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
        self.late = self.entries
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.lanes, self.lanes_used = np.zeros(1 << 16, dtype=np.uint64), 0

    def _room(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), dtype=have.dtype)]))

    def _append(self, got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in got], dtype=np.int64)
        total = int(n.sum())
        self._room("flat", self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter((i for x in got for i in x), dtype=np.uint32, count=total)
        start = self.used + np.cumsum(n) - n
        self.used += total
        return start, n

    def find(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each raw[begin:end] are in `flat`, and how many; encode(bytes) gives those of a new one."""
        if len(self.entries[0]) + len(self.late[0]) > _KNOWN or self.used > 8 * _KNOWN or self.lanes_used > 4 * _KNOWN:
            self.forget()
        x = W.lanes(raw, begin, end)
        hashes = W.hash_lanes(x)
        order = np.argsort(hashes)
        h = hashes[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = h[1:] != h[:-1]
        one, rank = h[fresh], np.cumsum(fresh) - 1
        some = order[np.flatnonzero(fresh)]
        start, count, lane, size = (np.full(len(one), -1, dtype=np.int64) for _ in range(4))
        for entries in (self.entries, self.late):
            if len(entries[0]):
                at = np.minimum(np.searchsorted(entries[0], one), len(entries[0]) - 1)
                hit = entries[0][at] == one
                for to, have in zip((start, count, lane, size), entries[1:]):
                    to[hit] = have[at[hit]]
        missing = np.flatnonzero(count < 0)
        if len(missing):
            where = some[missing]
            start[missing], count[missing] = self._append([encode(raw[begin[i] : end[i]].tobytes()) for i in where.tolist()])
            own = x.count[where]
            self._room("lanes", self.lanes_used + int(own.sum()))
            lane[missing], size[missing] = self.lanes_used + np.cumsum(own) - own, x.size[where]
            self.lanes[self.lanes_used : self.lanes_used + int(own.sum())] = x.values[_runs(x.first[where], own)]
            self.lanes_used += int(own.sum())
            late = [np.concatenate([a, b[missing]]) for a, b in zip(self.late, (one, start, count, lane, size))]
            o = np.argsort(late[0])
            self.late = tuple(v[o] for v in late)
            if 8 * len(o) > len(self.entries[0]):
                both = [np.concatenate([a, b]) for a, b in zip(self.entries, self.late)]
                o = np.argsort(both[0])
                self.entries = tuple(v[o] for v in both)
                self.late = tuple(v[:0] for v in self.late)
        s, c, at, n = (np.empty(len(h), dtype=np.int64) for _ in range(4))
        for to, have in zip((s, c, at, n), (start, count, lane, size)):
            to[order] = have[rank]
        unlike = n != x.size
        same = np.flatnonzero(~unlike)
        if len(x.values) == len(x.first):
            unlike[same] = self.lanes[at[same]] != x.values[same]
        elif len(same):
            own = x.count[same]
            off = self.lanes[_runs(at[same], own)] != x.values[_runs(x.first[same], own)]
            unlike[same] = np.logical_or.reduceat(off, np.cumsum(own) - own)
        bad = np.flatnonzero(unlike)
        if len(bad):  # another pre-token has the hash of these
            s[bad], c[bad] = self._append([encode(raw[begin[i] : end[i]].tobytes()) for i in bad.tolist()])
        return s, c

    def ids(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.flat[_runs(s, c)]


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1]."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Encoded:
    """Ids of texts in a row; those of text d are ids[first[d]:first[d + 1]], `at` is each id's first byte in its text, `size` its bytes."""

    ids: np.ndarray
    first: np.ndarray
    at: np.ndarray | None = None
    size: np.ndarray | None = None


class Encoder:
    """path: a vocabulary file of the tokenizers library, byte-level BPE with or without word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.word_end = spec["model"].get("end_of_word_suffix") or ""
        self.keep_space = not self.lower
        self.letters = byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int32)
        for piece, i in vocab.items():
            self.width[i] = len(piece.removesuffix(self.word_end) if self.word_end else piece)
        self.known, self.odd = Known(), Known()

    def _spans(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens of plain texts with a line feed between them."""
        kind = _CLASS[raw]
        new = np.ones(len(raw) + 1, dtype=bool)
        new[1:-1] = kind[1:] != kind[:-1]
        if not self.keep_space:
            new[:-1] |= kind == _DIGIT
            edge = np.flatnonzero(new)
            start, end = edge[:-1], edge[1:]
            solid = kind[start] != _SPACE
            return start[solid], end[solid]
        # a space before something solid belongs to it; of other white space before it, the last is apart
        before = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE))
        new[before] = True
        new[before[raw[before] == 0x20] + 1] = False
        edge = np.flatnonzero(new)
        return edge[:-1], edge[1:]

    def _encode(self, word: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in word]))]

    def encode(self, texts: list[str | None], offsets: bool = False) -> Encoded:
        """Ids of every whole text; None is empty. offsets: with each id's place, for vocabularies that keep white space."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        easy = [plain(p) for p in parts]
        own = [p for p, e in zip(parts, easy) if e]
        base = np.zeros(len(own) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in own], out=base[1:])
        raw = np.frombuffer(b"\n".join(own) + b"\n", dtype=np.uint8)
        if self.lower:
            raw = _LOWER[raw]
            # U+00C0 to U+00DE but the multiplication sign are 0x20 below their lower case
            high = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)) + 1
            raw[high] += 0x20
        if self.keep_space:
            found = [self._spans(np.frombuffer(p, dtype=np.uint8)) if p else (base[:0], base[:0]) for p in own]
            start = np.concatenate([base[:0], *(s + base[i] for i, (s, _) in enumerate(found))])
            end = np.concatenate([base[:0], *(e + base[i] for i, (_, e) in enumerate(found))])
        else:
            start, end = self._spans(raw)
        s, c = self.known.find(raw, start, end, self._encode)
        ids = self.known.ids(s, c)
        cum = np.concatenate([[0], np.cumsum(c)])
        first = cum[np.searchsorted(start, base)]
        at = None
        if offsets:
            size = self.width[ids].astype(np.int64)
            run = np.cumsum(size) - size
            lead = cum[:-1]
            at = np.repeat(start - np.where(c > 0, run[np.minimum(lead, max(len(run) - 1, 0))] if len(run) else 0, 0), c) + run
            at -= np.repeat(base[:-1], np.diff(first))
        if all(easy):
            return Encoded(ids, first, at, self.width[ids] if offsets else None)
        pieces, places, n = [], [], 0
        for p, e in zip(parts, easy):
            if e:
                pieces.append(ids[first[n] : first[n + 1]])
                if offsets:
                    places.append(at[first[n] : first[n + 1]])
                n += 1
            else:
                x, y = self._odd(p.decode("utf-8", "surrogatepass"), offsets)
                pieces.append(x)
                places.append(y)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        ids = np.concatenate([np.zeros(0, np.uint32), *pieces])
        return Encoded(ids, ends, np.concatenate(places) if offsets else None, self.width[ids] if offsets else None)

    def _odd(self, text: str, offsets: bool) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if self.keep_space:
            import public_tokenizers
            import regex

            ends = np.cumsum([len(m.encode("utf-8", "surrogatepass")) for m in regex.findall(public_tokenizers.PATTERN, text)], dtype=np.int64)
            start = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            ids = self.known.ids(*self.known.find(raw, start, ends, self._encode))
            size = self.width[ids].astype(np.int64)
            return ids, np.cumsum(size) - size
        solid = W.BY_SPACE[raw]
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
        got = self.odd.find(raw, edge[::2], edge[1::2], lambda w: self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return self.odd.ids(*got), np.zeros(0, np.int64)


_LOWER = W.LOWER
_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
