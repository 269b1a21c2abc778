"""A double-array trie over sequences of numbers, built and walked with numpy."""

from __future__ import annotations

import numpy as np

#: A number is spelled in digits of so many bits, so that a state has at most 1024 children, close together.
BITS = 10
#: Numbers up to this one are told by a table, larger ones by binary search.
_TABLE = 1 << 24


class DoubleArray:
    """Rows of ``grams`` (n, k), distinct positive numbers in any order; ``walk`` finds them in a text.

    State s has its child by digit d at slot ``base[s] + d`` if ``check`` of that slot is s. The root is slot 0.
    A state in which a row of ``grams`` ends has no children; its ``base`` is that row.
    """

    def __init__(self, grams: np.ndarray, seed: int = 1):
        self.length = grams.shape[1]
        self.known = np.unique(grams)
        self.digits = 1
        while len(self.known) >> (BITS * self.digits):
            self.digits += 1
        shifts = np.array([BITS * (self.digits - 1 - d) for d in range(self.digits)])
        symbols = np.concatenate([((np.searchsorted(self.known, grams[:, [j]]) + 1 >> shifts) & ((1 << BITS) - 1)).astype(np.int16) for j in range(self.length)], axis=1)
        order = np.lexsort(symbols.T[::-1])
        symbols = symbols[order]
        self._random = np.random.default_rng(seed)
        self.base, self.check, self._owner = np.zeros(4096, np.int32), np.full(4096, -1, np.int32), np.zeros(4096, np.int32)
        self.check[0] = -2  # the root's own slot is taken
        self._room(2 * sum(np.count_nonzero(self._fresh(symbols, j)) for j in range(symbols.shape[1])))
        slot_of_row = np.zeros(len(symbols), np.int32)
        for j in range(symbols.shape[1]):
            firsts = np.flatnonzero(self._fresh(symbols, j))
            parents, signs = slot_of_row[firsts], symbols[firsts, j]
            slots = self._place(parents, signs)
            slot_of_row = np.repeat(slots, np.diff(firsts, append=len(symbols)))
        last = int(np.flatnonzero(self.check != -1).max()) + 1
        end = max(last, int(self.base.max()) + 1) + (1 << BITS)
        if end > len(self.check):
            self._room_to(end)
        self.base[slot_of_row] = order
        del self._owner, self._random
        self.base, self.check = self.base[:end].copy(), self.check[:end].copy()
        self._table = None

    @staticmethod
    def _fresh(symbols: np.ndarray, j: int) -> np.ndarray:
        """Whether a row's first j + 1 symbols aren't those of the row before."""
        fresh = np.ones(len(symbols), bool)
        fresh[1:] = (symbols[1:, : j + 1] != symbols[:-1, : j + 1]).any(1)
        return fresh

    def _room_to(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self._owner = np.concatenate([self._owner, np.zeros(more, np.int32)])

    def _room(self, more: int) -> None:
        self._room_to(len(self.check) + more)

    def _place(self, parents: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Slots of children, given their parents' slots (together, in order) and their digits; sets base and check."""
        firsts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(firsts, append=len(parents))
        slots = np.zeros(len(parents), np.int32)
        for size in np.unique(sizes)[::-1]:
            waiting, tries = firsts[sizes == size], 0
            while len(waiting):
                now = waiting[: max(1, (1 << 20) // int(size))]
                rows = now[:, None] + np.arange(size)
                base = self._random.integers(1, len(self.check) - (1 << BITS), len(now))
                wanted = base[:, None] + signs[rows]
                free = (self.check[wanted] == -1).all(1)
                at = np.flatnonzero(free)
                self._owner[wanted[at]] = at[:, None]
                won = at[(self._owner[wanted[at]] == at[:, None]).all(1)]
                owners = parents[now[won]]
                self.base[owners] = base[won]
                self.check[wanted[won]] = owners[:, None]
                slots[rows[won]] = wanted[won]
                left = np.ones(len(waiting), bool)
                left[won] = False
                waiting, tries = waiting[left], tries + 1
                if tries % 8 == 0:
                    self._room(max(4 << BITS, 2 * int(size) * len(waiting)))
        return slots

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """Numbers as the trie's own, from 1; 0 for others."""
        if self.known[-1] < _TABLE:
            if self._table is None:  # made where the trie is used, once for all texts
                self._table = np.zeros(int(self.known[-1]) + 2, np.int32)
                self._table[self.known] = np.arange(1, len(self.known) + 1)
            return self._table[np.minimum(ids, len(self._table) - 1)]
        at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
        return np.where(self.known[at] == ids, at + 1, 0)

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of ``ids`` where a row begins, ascending, and which row it is; all places advance together, digit by digit."""
        codes = self._codes(ids)
        at = np.arange(max(0, len(ids) - self.length + 1))
        state = np.zeros(len(at), np.int32)
        for j in range(self.length):
            code = codes[at + j]
            go = code > 0
            at, state, code = at[go], state[go], code[go]
            for d in range(self.digits):
                slot = self.base[state] + ((code >> (BITS * (self.digits - 1 - d))) & ((1 << BITS) - 1))
                go = self.check[slot] == state
                at, state, code = at[go], slot[go], code[go]
        return at, self.base[state]
