"""Quantised probability tables and a 32-bit arithmetic coder (row kernels).

The coder keeps the interval [low, high] of 32-bit integers. A symbol takes its
share of the interval; while both ends agree in their first bit that bit is
written, and while they straddle the middle closely the middle is stretched and
the bit is owed."""

from __future__ import annotations

import numpy as np

TOP, HALF, QUARTER = 0xFFFFFFFF, 0x80000000, 0x40000000


def quantize(probs: np.ndarray, total: int) -> np.ndarray:
    """Cumulative counts, one row for each distribution: every symbol gets one
    count and its share of the rest, and what rounding leaves goes to the first
    of the largest."""
    rows, size = probs.shape
    counts = np.maximum(np.trunc(probs * (total - size)), 0).astype(np.int64) + 1
    counts[np.arange(rows), counts.argmax(1)] += total - counts.sum(1)
    out = np.zeros((rows, size + 1), dtype=np.int64)
    np.cumsum(counts, axis=1, out=out[:, 1:])
    return out


class Encoder:
    def __init__(self) -> None:
        self.low, self.high, self.owed = 0, TOP, 0
        self.bits: list[str] = []
        self.written = 0

    def _emit(self, bit: int) -> None:
        self.bits.append(("1" + "0" * self.owed) if bit else ("0" + "1" * self.owed))
        self.written += 1 + self.owed
        self.owed = 0

    def encode(self, start: int, end: int, total: int) -> None:
        """Narrow to the symbol that has counts ``start`` to ``end`` of ``total``."""
        width = self.high - self.low + 1
        low, high = self.low + width * start // total, self.low + width * end // total - 1
        while True:
            if high < HALF:
                self._emit(0)
            elif low >= HALF:
                self._emit(1)
                low, high = low - HALF, high - HALF
            elif low >= QUARTER and high < HALF + QUARTER:
                self.owed += 1
                low, high = low - QUARTER, high - QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
        self.low, self.high = low, high

    @property
    def bit_count(self) -> int:
        """Bits written and owed; read before ``finish``."""
        return self.written + self.owed

    def finish(self) -> bytes:
        self.owed += 1
        self._emit(0 if self.low < QUARTER else 1)
        text = "".join(self.bits)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 32
        self.low, self.high = 0, TOP
        self.size = 8 * len(data)
        self.value = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def _bit(self) -> int:
        at = self.at
        self.at += 1
        return self.data[at >> 3] >> (7 - (at & 7)) & 1 if at < self.size else 0

    def decode(self, cdf: np.ndarray) -> int:
        total = int(cdf[-1])
        width = self.high - self.low + 1
        target = ((self.value - self.low + 1) * total - 1) // width
        symbol = int(np.searchsorted(cdf[1:], target, side="right"))
        low, high = self.low + width * int(cdf[symbol]) // total, self.low + width * int(cdf[symbol + 1]) // total - 1
        value = self.value
        while True:
            if high < HALF:
                pass
            elif low >= HALF:
                low, high, value = low - HALF, high - HALF, value - HALF
            elif low >= QUARTER and high < HALF + QUARTER:
                low, high, value = low - QUARTER, high - QUARTER, value - QUARTER
            else:
                break
            low, high, value = 2 * low, 2 * high + 1, 2 * value + self._bit()
        self.low, self.high, self.value = low, high, value
        return symbol


def encode_symbols(symbols: list[int], tables: list[np.ndarray]) -> tuple[bytes, int]:
    """Bytes and bit count of symbols under one table, or a table for each."""
    coder = Encoder()
    for i, s in enumerate(symbols):
        cdf = tables[i] if len(tables) > 1 else tables[0]
        coder.encode(int(cdf[s]), int(cdf[s + 1]), int(cdf[-1]))
    bits = coder.bit_count
    return coder.finish(), bits


def decode_symbols(data: bytes, n: int, tables: list[np.ndarray]) -> list[int]:
    coder = Decoder(data)
    return [coder.decode(tables[i] if len(tables) > 1 else tables[0]) for i in range(n)]
