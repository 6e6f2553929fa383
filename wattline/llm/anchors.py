"""Content-chosen anchors: the minimum k-gram of every fixed window, on whole numpy buffers.

Two equal windows hold the same minimum at the same place, so rows keyed by the anchor's hash meet wherever their windows are equal.
Runs of windows with one anchor are handled as one row.  Everything works in blocks, so a text of any length needs bounded memory.
"""

from __future__ import annotations

import numpy as np

_POS_BITS = 24                      # block positions ride in the low bits, which also makes the leftmost minimum win ties
BLOCK = 1 << 16                     # symbols handled at once: arrays stay in cache, places far below 2 ** _POS_BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (in place on a copy)."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(symbols: np.ndarray, k: int, base: np.uint64 = _ODD) -> np.ndarray:
    """Scrambled polynomial hash of each run of k symbols (uint64 in, len - k + 1 out), by doubling: O(n log k)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, width, power = None, 1, base
    cur, left, have = symbols, k, 0
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, have = cur, width
                else:
                    m = min(len(done) - width, len(cur))
                    done = cur[:m] * _pow(base, have) + done[width:width + m]
                    have += width
            left >>= 1
            if left:
                cur = cur[:len(cur) - width] * power + cur[width:]
                power = power * power
                width *= 2
        return mix64(done[:n])


def _pow(base: np.uint64, e: int) -> np.uint64:
    return np.uint64(pow(int(base), e, 1 << 64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    width, cur = 1, x
    while width * 2 <= w:
        cur = np.minimum(cur[:len(cur) - width], cur[width:])
        width *= 2
    if width < w:
        n, shift = len(x) - w + 1, w - width
        cur = np.minimum(cur[:n], cur[shift:shift + n])
    return cur


def runs(symbols: np.ndarray, window: int, k: int, starts: np.ndarray, lengths: np.ndarray):
    """Runs of consecutive windows with one anchor, for texts laid end to end in `symbols` (unsigned integers).

    starts, lengths: of the texts.  Returns (text, first, count, anchor, key): the text's index, the first window's place in `symbols`, the
    number of windows, the anchor's place and its k-gram hash.  Windows never reach over the end of a text.
    """
    total, w, out = len(symbols), window - k + 1, []
    for at in range(0, total, BLOCK):
        end = min(total, at + BLOCK + window - 1)
        if end - at < window:
            break
        h = gram_hashes(symbols[at:end].astype(np.uint64), k)
        low = np.uint64((1 << _POS_BITS) - 1)
        m = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w)
        place = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        out.append((first + at, count, place[first] + at, h[place[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    first, count, anchor, key = (np.concatenate(x) for x in zip(*out, strict=True))
    # cut the runs at the ends of texts: a window belongs to the text of its first symbol and must end in it
    usable = np.maximum(lengths - window + 1, 0)
    text = np.searchsorted(starts, first, side="right") - 1
    last = np.searchsorted(starts, first + count - 1, side="right") - 1
    many = last - text + 1
    if (many > 1).any():
        src = np.repeat(np.arange(len(first)), many)
        step = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        text = text[src] + step
        a = np.maximum(first[src], starts[text])
        b = np.minimum(first[src] + count[src], starts[text] + usable[text])
        anchor, key = anchor[src], key[src]
    else:
        a, b = first, np.minimum(first + count, starts[text] + usable[text])
    ok = b > a
    return text[ok], a[ok], (b - a)[ok], anchor[ok], key[ok]
