"""Elias-Fano coding of rising numbers, with select."""

from __future__ import annotations

import numpy as np

# Ones between two sampled positions of the high bits.
SAMPLE = 256


class EliasFano:
    """Rising numbers x[0] <= ... <= x[n-1] in about 2 + log2(x[n-1] / n) bits each.

    The low bits of each number are packed side by side. Its high bits say how
    many zeros precede its one in a bit vector. ``select`` finds the position
    of the i-th one from a sample of every 256th position, kept in 32 bits,
    and reads on from there.
    """

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, "<u4"))
        if np.any(values[1:] < values[:-1]):
            raise ValueError("the numbers have to rise")
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("too many numbers for one sequence")
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(high, bitorder="little"), np.packbits(low, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if self.low_bits == 0:
            return np.zeros(last - first, np.int64)
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        # Bits of the first byte before the sampled one do not count.
        current = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := current.bit_count()) <= left:
            left -= ones
            byte += 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        position = byte * 8 + (current & -current).bit_length() - 1
        return ((position - i) << self.low_bits) | int(self._lows(i, i + 1)[0])

    def between(self, first: int, last: int) -> np.ndarray:
        """The numbers from place ``first`` to before place ``last``; only the bits around them are decoded."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        begin, after = int(self.samples[first // SAMPLE]), -(-last // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")) + begin // 8 * 8
        ones = ones[ones >= begin][first % SAMPLE :][: last - first]
        return ((ones - np.arange(first, last)) << self.low_bits) | self._lows(first, last)

    def place_after(self, value: int, first: int = 0) -> int:
        """The first place from ``first`` on whose number is over ``value``, by halving with ``select``."""
        low, high = first, self.n
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) > value:
                high = middle
            else:
                low = middle + 1
        return low

    def all(self) -> np.ndarray:
        """All numbers in order."""
        return self.between(0, self.n)

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.high.tobytes(), self.low.tobytes(), self.samples.tobytes()

    @classmethod
    def from_parts(cls, n: int, low_bits: int, high: bytes, low: bytes, samples: bytes) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8), np.frombuffer(samples, "<u4"))
