"""Ascending numbers in near-minimal space: Elias-Fano codes with a select structure.

n numbers below u take n * ceil(log2(u / n)) low bits and at most 2n + 1 high bits. Number i is the place of the i-th
set high bit minus i, followed by its low bits; the place is found from a 32-bit sample per 256 numbers.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBI")  # numbers, largest, low bits, bytes of high bits
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(numbers: np.ndarray) -> bytes:
    """``numbers``: ascending, not negative, repeats allowed."""
    n = len(numbers)
    top = int(numbers[-1]) if n else 0
    low = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
    x = numbers.astype(np.uint64)
    lows = np.zeros(0, np.uint8)
    if low and n:
        bits = (x[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
    places = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = (int(places[-1]) + 8) // 8 if n else 0
    high = np.zeros(size, np.uint8)
    np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
    samples = places[::SAMPLE].astype("<u4")
    return _HEAD.pack(n, top, low, size) + samples.tobytes() + lows.tobytes() + high.tobytes()


class Numbers:
    """Encoded numbers, read in place from a buffer; ``size`` is the bytes they take."""

    def __init__(self, buffer: memoryview | bytes):
        view = memoryview(buffer)
        self.n, self.top, self.low, high = _HEAD.unpack_from(view, 0)
        at = _HEAD.size
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(view, "<u4", count, at)
        at += 4 * count
        width = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(view, np.uint8, width, at)
        at += width
        self.high = np.frombuffer(view, np.uint8, high, at)
        self.size = at + high

    def _low(self, i: int) -> int:
        first = i * self.low
        part = self.lows[first >> 3: (first + self.low + 7) >> 3]
        return (int.from_bytes(part.tobytes(), "little") >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Number ``i`` alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) & (0xFF << (place & 7)) & 0xFF  # the sampled bit is the first one counted
        while left >= _ONES[byte]:
            left -= int(_ONES[byte])
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        """All numbers as 64-bit integers, for reading a whole file."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return out.astype(np.int64)
