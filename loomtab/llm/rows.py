"""Rows of ids that a task remembers by word, in arrays and bounded in bytes."""

from __future__ import annotations

import re

import numpy as np

#: A full stop or comma between a Latin letter and white space or the end: by itself in any pattern that parts letters from marks.
STOPS = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([.,])(?=[ \n]|\Z)")


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of ``pool`` one after another."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``array`` with ``new`` from ``at`` on, grown by halves if it must."""
    if at + len(new) > len(array):
        grown = np.zeros(max(at + len(new), len(array) * 3 // 2), array.dtype)
        grown[:at] = array[:at]
        array = grown
    array[at : at + len(new)] = new
    return array


class Rows:
    """Words and their ids.  ``memory`` bytes at most, about; words of more than ``LONG`` characters are kept for a run only."""

    #: Bytes that a word takes besides its characters: its string, its place in the table, its number and its ids.
    ENTRY = 140
    LONG = 64

    def __init__(self, dtype: type, memory: int):
        self.dtype, self.memory = dtype, memory
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.held = self.rows = self.used = 0
        self.pool = np.zeros(0, self.dtype)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def put(self, words: list[str], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """A row for each word: ``sizes`` of ``flat`` from ``starts`` on."""
        self.pool = _put(self.pool, self.used, flat)
        self.starts = _put(self.starts, self.rows, self.used + starts)
        self.lengths = _put(self.lengths, self.rows, sizes)
        self.words.update(zip(words, range(self.rows, self.rows + len(words)), strict=True))
        self.rows, self.used = self.rows + len(words), self.used + len(flat)
        self.held += sum(map(len, words)) + self.ENTRY * len(words)

    def put_joined(self, cut: dict[str, list[str]]) -> None:
        """Words that consist of words that are there."""
        if not cut:
            return
        rows = np.array([self.words[p] for found in cut.values() for p in found])
        counts = np.array([len(found) for found in cut.values()])
        sizes = np.add.reduceat(self.lengths[rows], np.cumsum(counts) - counts)
        self.put(list(cut), gather(self.pool, self.starts[rows], self.lengths[rows]), np.cumsum(sizes) - sizes, sizes)

    def flat(self, units: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many come before each unit, and all); ``learn`` puts the words of a set."""
        fresh = set(units).difference(self.words)
        long = {w for w in fresh if len(w) > self.LONG}
        fresh -= long
        # twice: a word may bring a piece with it
        if self.held + 2 * (sum(map(len, fresh)) + self.ENTRY * len(fresh)) > self.memory:
            self.forget()
            fresh = set(units) - long
        learn(fresh)
        if long:
            kept = self.rows, self.used, self.held, set(self.words)
            learn(long)
        rows = np.fromiter(map(self.words.__getitem__, units), np.int64, len(units))
        lengths = self.lengths[rows]
        flat = gather(self.pool, self.starts[rows], lengths)
        if long:
            self.rows, self.used, self.held, words = kept
            self.words = {w: self.words[w] for w in words}
        return flat, np.concatenate([[0], np.cumsum(lengths)])
