"""Elias-Fano coding of ascending offsets, with select: near the least space, no table of 64-bit offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A sampled place of every so many ones: where a select starts to count.
SAMPLE = 256
#: Low bits at most, so that a value's low bits lie within eight bytes wherever they start.
MOST_LOW = 56
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one of each byte value.
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)


@dataclass
class EliasFano:
    """n values up to `universe`: `low_bits` low bits each, packed; the high parts in unary in the bits of `high`."""

    n: int
    universe: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes  # int32 byte index of every SAMPLE-th one, and ones before that byte

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        bits = min(MOST_LOW, max(0, (universe // n).bit_length() - 1)) if n else 0
        low = values & ((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> bits) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little")
        before = np.concatenate([[0], np.cumsum(_POP[high], dtype=np.int64)])
        at = ones[::SAMPLE] >> 3
        samples = np.stack([at, before[at]], axis=1).astype("<i4").tobytes() if n else b""
        return cls(n, universe, bits, packed, high.tobytes(), samples)

    def _lows(self, index: np.ndarray) -> np.ndarray:
        """Low bits of the values at `index`, read where they lie."""
        if not self.low_bits:
            return np.zeros(len(index), np.int64)
        at = index * self.low_bits
        raw = np.frombuffer(self.low, np.uint8)
        window = raw[np.minimum((at >> 3)[:, None] + np.arange(8), len(raw) - 1)].view("<u8").ravel()
        return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1: from the nearest sample on, ones are counted byte by byte up to the last of them."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        samples = np.frombuffer(self.samples, "<i4").reshape(-1, 2).astype(np.int64)
        begin, ones = samples[first // SAMPLE]
        after = -(-last // SAMPLE)  # the first sampled one that is not asked for
        stop = samples[after, 0] + 1 if after < len(samples) else None
        high = np.frombuffer(self.high, np.uint8)[begin:stop]
        upto = ones + np.cumsum(_POP[high], dtype=np.int64)
        index = np.arange(first, last)
        byte = np.searchsorted(upto, index, "right")
        nth = index - (upto[byte] - _POP[high[byte]])
        place = (begin + byte) * 8 + _PLACE[high[byte], nth]
        return ((place - index) << self.low_bits) | self._lows(index)
