"""Static double-array tries in numpy: child c of state s is cell BASE[s] + c, and it is s's child only if CHECK of that cell is s.

`pack` lays out many sequences of dense labels level by level.  Children of one state share a BASE; a state with several children takes the
first place where all of them fit, states with one child fill the holes that are left.  Cell 0 is the root.
"""

from __future__ import annotations

import numpy as np

TRIES = 64                          # free places tried for a state with several children before it goes to the end; moves cells, never drops any


class DoubleArray:
    def __init__(self, labels: int):
        size = 2 * max(1, labels) + 2
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.used = np.zeros(size, bool)
        self.used[0] = True
        self.top = self.low = 1     # every cell from `top` on is free, none below `low` is

    def _reach(self, cell: int) -> None:
        if cell >= len(self.used):
            more = max(cell + 1, 2 * len(self.used)) - len(self.used)
            self.base, self.used = np.append(self.base, np.zeros(more, np.int64)), np.append(self.used, np.zeros(more, bool))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _place(self, labels: np.ndarray) -> int:
        """BASE for a state whose children are these ascending labels."""
        off = labels - labels[0]
        for free in self.low + np.flatnonzero(~self.used[self.low:self.top])[:TRIES]:
            cells = free + off
            self._reach(int(cells[-1]))
            if not self.used[cells].any():
                return int(free - labels[0])
        self._reach(int(self.top + off[-1]))
        return int(self.top - labels[0])

    def _take(self, cells: np.ndarray, parents: np.ndarray) -> None:
        self.used[cells], self.check[cells] = True, parents
        self.top = max(self.top, int(cells.max()) + 1)
        free = np.flatnonzero(~self.used[self.low:self.top])
        self.low = self.low + int(free[0]) if len(free) else self.top

    def children(self, states: np.ndarray, labels: np.ndarray) -> None:
        """Add all children of some childless states: pairs sorted by (state, label), each once."""
        first = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        count = np.diff(np.append(first, len(states)))
        for i in np.flatnonzero(count > 1):
            s, c = states[first[i]], labels[first[i]:first[i] + count[i]]
            self.base[s] = self._place(c)
            self._take(self.base[s] + c, s)
        alone = first[count == 1]
        if len(alone):
            holes = self.low + np.flatnonzero(~self.used[self.low:self.top])[:len(alone)]
            cells = np.concatenate((holes, self.top + np.arange(len(alone) - len(holes))))
            self._reach(int(cells.max()))
            self.base[states[alone]] = cells - labels[alone]
            self._take(cells, states[alone])

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each state under its label, -1 where there is none."""
        cells = self.base[states] + labels
        inside = (cells > 0) & (cells < len(self.check))
        good = inside & (self.check[np.where(inside, cells, 0)] == states)
        return np.where(good, cells, -1)


def pack(labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of the sequences labels[start:start + length]; labels are dense, from 0."""
    trie = DoubleArray(int(labels.max()) + 1 if len(labels) else 0)
    alive, state, depth = np.flatnonzero(lengths > 0), np.zeros(len(starts), np.int64), 0
    wide = np.int64(labels.max()) + 1 if len(labels) else np.int64(1)
    while len(alive):
        pair = np.unique(state[alive] * wide + labels[starts[alive] + depth])
        trie.children(pair // wide, pair % wide)
        state[alive] = trie.step(state[alive], labels[starts[alive] + depth])
        depth += 1
        alive = alive[lengths[alive] > depth]
    return trie


def walk(trie: DoubleArray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state after each label of each sequence, laid out as `labels` is; -1 from where a sequence leaves the trie."""
    out, alive, state, depth = np.full(len(labels), -1, np.int64), np.flatnonzero(lengths > 0), np.zeros(len(starts), np.int64), 0
    while len(alive):
        at = starts[alive] + depth
        out[at] = state[alive] = trie.step(state[alive], labels[at])
        depth += 1
        alive = alive[(lengths[alive] > depth) & (state[alive] >= 0)]
    return out
