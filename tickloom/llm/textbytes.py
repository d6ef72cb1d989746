"""Words of many texts at once: numpy over the UTF-8 buffer of an Arrow string column.

Used inside Arrow tasks. Texts go through in slices of a bounded number of bytes (a longer
text is a slice of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice takes about 40 times this: arrays of eight bytes for each byte of text, and the powers.
SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def byte_table(breaks: bytes) -> np.ndarray:
    """Lower-casing table of the 256 byte values; 0 for those of `breaks`."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(breaks)] = 0
    return table


#: Words are runs of other than ASCII white space (and NUL).
SPACED = byte_table(bytes([0, 32, *range(9, 14)]))
#: Words are runs of ASCII letters, digits and any other than ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising mixer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _power(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2^64. Those for a slice are kept, longer ones go with the call."""
    if _powers and len(_powers[0]) > n:
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= SLICE_BYTES:
        _powers[:] = made
    return made


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) until all rows are through. Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: `begin` and `end` in bytes, `hash` of the lower-cased word, and `first`, where each text's words start (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        code = table[data]
        inside = code != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.code = code
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.begin, offsets)
        up, down = _power(len(data))
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(code * up[: len(data)], out=total[1:])
            self.hash = mix64((total[self.end] - total[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.begin)

    def spelled(self, at: int, n: int) -> bytes:
        """The n lower-case words from word `at` on, with a space between them."""
        return b" ".join(self.code[a:b].tobytes() for a, b in zip(self.begin[at : at + n], self.end[at : at + n]))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, as far as the slice goes (they may cross into the next text)."""
        count = max(0, len(self) - n + 1)
        out = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + count]
        return mix64(out)
