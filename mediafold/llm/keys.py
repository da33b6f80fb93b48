"""Exact lookup of short byte strings in whole arrays.

A string of at most ``SHORT`` bytes is its own key: its bytes fill two 64-bit words, with its length in the last byte, so two
strings have one key only if they are equal and no hash has to be trusted.  :class:`KeyTable` is an open-addressed table
of such keys; a lookup of a million keys is a few array operations.
"""

from __future__ import annotations

import numpy as np

from mediafold.llm.common import mix

SHORT = 15
#: A table holds at most so many keys (18 bytes a slot, two to four slots a key), which bounds what is broadcast.
MAX_KEYS = 1 << 20

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the spans ``start, length`` (1 to ``SHORT`` bytes each) of ``data``."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[:len(data)] = data
    words = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    a = words[start] & _MASK[np.minimum(length, 8)]
    b = words[start + 8] & _MASK[np.maximum(length - 8, 0)]
    b |= length.astype(np.uint64) << np.uint64(56)
    return a, b


def packed_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(strings), np.uint8)
    length = np.array([len(s) for s in strings], np.int64)
    return packed(data, np.cumsum(length) - length, length)


class KeyTable:
    """Short byte strings and a small number of each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray):
        """Keys must differ from each other."""
        if len(a) > MAX_KEYS:
            raise ValueError(f"a table holds at most {MAX_KEYS} keys, not {len(a)}")
        size = 1 << max(4, int(2 * len(a)).bit_length())
        self.a, self.b = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.value = np.zeros(size, values.dtype)
        slot, rest = self._slot(a, b), np.arange(len(a))
        while len(rest):
            free = rest[self.b[slot[rest]] == 0]
            _, first = np.unique(slot[free], return_index=True)  # one key a free slot, the others go on
            put = free[first]
            self.a[slot[put]], self.b[slot[put]], self.value[slot[put]] = a[put], b[put], values[put]
            rest = np.setdiff1d(rest, put)
            slot[rest] = (slot[rest] + 1) & (size - 1)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a ^ mix(b)) & np.uint64(len(self.b) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for a key that the table does not hold."""
        out = np.full(len(a), -1, np.int64)
        slot, live = self._slot(a, b), np.arange(len(a))
        while len(live):
            there = self.b[slot]
            hit = (there == b[live]) & (self.a[slot] == a[live])
            out[live[hit]] = self.value[slot[hit]]
            on = ~hit & (there != 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.b) - 1)
        return out
