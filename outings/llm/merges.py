"""Pair merges for many words at once, on flat numpy arrays."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 40)


class PairTable:
    """Looks up (left, right) symbol pairs: a few tables of slots, each pair sits in the first where its slot was free."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        rest, bits, self.levels = np.arange(len(keys)), max(10, int(len(keys)).bit_length() + 2), []
        salt = 0x9E3779B97F4A7C15
        while len(rest):
            slot = self._slot(keys[rest], salt, bits)
            _, first = np.unique(slot, return_index=True)
            table_keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
            table_rows = np.full(1 << bits, -1, np.int64)
            table_keys[slot[first]], table_rows[slot[first]] = keys[rest[first]], rest[first]
            self.levels.append((salt, bits, table_keys, table_rows))
            rest = np.delete(rest, first)
            bits, salt = max(10, int(len(rest)).bit_length() + 2), (salt * 0xBF58476D1CE4E5B9 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ (keys >> np.uint64(29))) * np.uint64(salt) >> np.uint64(64 - bits)).astype(np.int64)

    def rows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of every pair, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for salt, bits, table_keys, table_rows in self.levels:
            slot = self._slot(keys, salt, bits)
            out = np.where(table_keys[slot] == keys, table_rows[slot], out)
        return out


class Merger:
    """Merges by rank: in a word the pair of least rank goes first, the leftmost first among equals.

    A round finds the least rank of every word (a segmented minimum) and merges all its occurrences that do not
    overlap, from the left; words without a pair leave the arrays. Where a merged symbol forms a pair of the same or a
    smaller rank with a neighbour, the occurrences to its right wait for the next round, because that pair goes first.
    """

    def __init__(self, left, right, rank, merged):
        self.table = PairTable(left, right)
        self.rank, self.merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of the words after all merges; words keep their order, and none may be empty."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        symbols = symbols.astype(np.int64)
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(word)])))
            row = np.full(len(symbols), -1, np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            row[inner] = self.table.rows(symbols[inner], symbols[inner + 1])
            rank = np.where(row >= 0, self.rank[row], NONE)
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done_symbols.append(symbols[gone])
                done_words.append(word[gone])
                if over.all():
                    break
                symbols, word, row, rank = symbols[~gone], word[~gone], row[~gone], rank[~gone]
                best, sizes = best[~over], sizes[~over]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            opens = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            at = at[self._may_go(symbols, word, row, rank, at)]
            symbols[at] = self.merged[row[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return symbols, lengths
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(words, minlength=len(lengths))

    def _may_go(self, symbols, word, row, rank, at) -> np.ndarray:
        """Which of the occurrences ``at`` can be merged in one round: none to its left, in its word, forms a pair that
        would go before it."""
        new, limit, last = self.merged[row[at]], rank[at], len(symbols) - 1
        chosen = np.zeros(len(symbols) + 4, bool)
        chosen[at] = True
        early = np.zeros(len(at), bool)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        left_in, right_in = (at > 0) & (word[before] == word[at]), (at + 2 <= last) & (word[after] == word[at])
        for inside, left, right in ((left_in, symbols[before], new), (left_in & chosen[np.maximum(at - 2, 0)], new, new),
                                    (right_in, new, symbols[after]), (right_in & chosen[at + 2], new, new)):
            which = np.flatnonzero(inside)
            found = self.table.rows(left[which], right[which])
            early[which] |= (found >= 0) & (self.rank[found] <= limit[which])
        so_far = np.cumsum(early) - early
        first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
        opened = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return so_far == so_far[opened]
