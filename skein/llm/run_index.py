"""A run-length index of a text: run-compressed Burrows-Wheeler transform, sampled run ends, matching statistics from the samples."""

from __future__ import annotations

import numpy as np

from skein.operators.suffix import suffix_array


class RunLengthIndex:
    """symbols, lengths: the transform's runs (symbol -1: before the text's start). starts, ends: text positions at both ends of
    each run. samples, before, common: positions just left of a run's first suffix, the position that precedes each in suffix
    order (-1: none), and the length that the two have in common, counted up to most. All are as long as the number of runs.
    """

    def __init__(self, text: np.ndarray, most: int):
        n = len(text)
        self.n, self.most = n, most
        order = suffix_array(text)
        last = np.where(order > 0, text[order - 1].astype(np.int64), -1) if n else order
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1]))) if n else order
        self.symbols, self.lengths = last[heads], np.diff(np.append(heads, n))
        self.starts, self.ends = order[heads], order[heads + self.lengths - 1] if n else order
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sampled = np.zeros(n + 1, bool)  # places one further on: that of a run which starts at 0 is before the text
        sampled[self.starts] = True
        sampled[n] = n > 0
        samples = self.samples = np.flatnonzero(sampled[1:])
        self.before = np.where(place[samples] > 0, order[place[samples] - 1], -1) if n else order
        self.common = self._common(text)

    def _common(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.samples), np.int64)
        live = np.flatnonzero(self.before >= 0)
        # Eight symbols at a time for as long as they are equal, then one at a time.
        eight = np.ndarray(max(self.n - 7, 0), "<u8", np.ascontiguousarray(text), strides=(1,))
        one_by_one = []
        while len(live):
            a, b = self.samples[live] + out[live], self.before[live] + out[live]
            fits = np.maximum(a, b) < len(eight)
            same = np.zeros(len(live), bool)
            same[fits] = eight[a[fits]] == eight[b[fits]]
            one_by_one.append(live[~same])
            live = live[same]
            out[live] += 8
            live = live[out[live] < self.most]
        live = np.concatenate([live, *one_by_one])
        while len(live):
            a, b = self.samples[live] + out[live], self.before[live] + out[live]
            fits = (a < self.n) & (b < self.n)
            same = fits & (text[np.minimum(a, self.n - 1)] == text[np.minimum(b, self.n - 1)])
            live = live[same]
            out[live] += 1
            live = live[out[live] < self.most]
        return np.minimum(out, self.most)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position: the position before it in suffix order (-1: none) and how much they have in common, true up to most.

        Within a run both positions move in step with the text, so everything follows from the next sample to the right.
        """
        gaps = np.diff(np.concatenate(([-1], self.samples)))
        away = np.repeat(self.samples, gaps) - np.arange(self.n)
        before = np.repeat(self.before, gaps)
        return np.where(before >= 0, before - away, -1), np.where(before >= 0, np.repeat(self.common, gaps) + away, 0)


def later_copies(text: np.ndarray, length: int, valid: np.ndarray) -> np.ndarray:
    """Which valid positions start a string of that length that also starts at an earlier valid position.

    Positions whose matching statistics reach the length are chained to the one before them in suffix order; a chain has all
    positions of one string, and all but its first in the text are later copies.
    """
    before, common = RunLengthIndex(text, length).matching_statistics()
    chain = np.arange(len(text))
    linked = np.flatnonzero(common >= length)
    chain[linked] = before[linked]
    live = linked
    while len(live):
        further = chain[chain[live]]
        moved = further != chain[live]
        live = live[moved]
        chain[live] = further[moved]
    at = np.flatnonzero(valid)
    first = np.empty(len(text), np.int64)
    first[chain[at[::-1]]] = at[::-1]  # of equal places the last assignment holds: the first position
    out = np.zeros(len(text), bool)
    out[at] = first[chain[at]] < at
    return out
