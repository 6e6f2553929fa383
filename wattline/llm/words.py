"""Words of byte buffers, vectorised: runs of bytes other than ASCII white space, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np

from wattline.llm.anchors import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D
_SLICE = 1 << 17


def lower_ascii() -> np.ndarray:
    """Byte table that maps A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(first byte, end, text index) of every word; texts end words."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[lengths > 0]] = True                     # a text starts anew even without white space before it
    begins = ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1])))
    ends = ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    full = np.flatnonzero(lengths > 0)
    text = full[np.searchsorted(starts[full], first, side="right") - 1] if len(full) else np.zeros(0, np.int64)
    return first, end, text


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[first:end], in slices of many words so that the work stays in cache."""
    out = np.empty(len(first), np.uint64)
    longest = int((end - first).max()) if len(first) else 0
    power = np.empty(longest + 1, np.uint64)
    power[:] = _STEP
    power[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(power, out=power)
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + _SLICE)))
            a, b = first[i], end[j - 1]
            at = first[i:j] - a
            # place within the word, counted over all bytes from its start; the white space after it counts as zero
            begin = np.zeros(b - a, np.int64)
            begin[at] = np.diff(np.concatenate(([0], at)))
            place = np.arange(b - a) - np.cumsum(begin)
            value = _TABLE[data[a:b]] * power[np.minimum(place, longest)]
            value[_SPACE[data[a:b]]] = 0
            out[i:j] = np.add.reduceat(value, at)
            i = j
        return mix64(out + (end - first).astype(np.uint64))
