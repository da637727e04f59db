"""Elias-Fano coding of ascending integers, with sampled selection."""

from __future__ import annotations

import struct

import numpy as np

_SAMPLE = 256
_HEAD = "<QQBxxx"


def encode(values: np.ndarray) -> bytes:
    """Ascending integers from 0 on, in about 2 + log2(last / n) bits each, and a sample of the positions of the upper ones."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.zeros((n * low + 7) // 8 * 8, dtype=np.uint8)
    for b in range(low):
        bits[b : n * low : low] = (v >> np.uint64(b)) & np.uint64(1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, dtype=np.uint8)
    upper[ones] = 1
    samples = ones[::_SAMPLE].astype(np.uint32)
    head = struct.pack(_HEAD, n, len(upper) // 8, low)
    return head + np.packbits(bits, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes() + samples.tobytes()


class Reader:
    """select(i) is the i-th value; it looks at a sample and the few bytes that follow it."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, upper, self.low = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        lows = (self.n * self.low + 7) // 8
        self.lower = np.frombuffer(data, np.uint8, lows, at)
        self.upper = np.frombuffer(data, np.uint8, upper, at + lows)
        count = -(-self.n // _SAMPLE)
        self.samples = np.frombuffer(data, np.uint32, count, at + lows + upper)
        self.end = at + lows + upper + 4 * count

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        word = int.from_bytes(self.lower[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // _SAMPLE])
        rest = i % _SAMPLE
        byte, skip = at // 8, at % 8
        chunk = 64
        while True:
            bits = np.flatnonzero(np.unpackbits(self.upper[byte : byte + chunk], bitorder="little")[skip:])
            if len(bits) > rest:
                return (byte * 8 + skip + int(bits[rest]) - i) << self.low | self._low(i)
            rest -= len(bits)
            byte, skip = byte + chunk, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self.lower, bitorder="little")
        for b in range(self.low):
            out |= bits[b : self.n * self.low : self.low].astype(np.uint64) << np.uint64(b)
        return out.astype(np.int64)
