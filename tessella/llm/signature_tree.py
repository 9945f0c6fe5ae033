"""Signature tree over sets: nodes hold the OR of their sets' bitmaps and ranges of sizes; dual traversal finds pairs that may be similar."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

FANOUT = 8
#: Node pairs that are tested at once: what a traversal holds is some hundred times as many numbers, whatever the number of pairs.
_CHUNK = 1 << 12


class Level(NamedTuple):
    """Nodes of one height: OR of bitmaps, range of sizes, most elements without a bit of their own, ranges of groups and of sides."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spare: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def above(self) -> Level:
        at = np.arange(0, len(self.low), FANOUT)
        merge = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
        return Level(*(f.reduceat(column, at) for f, column in zip(merge, self, strict=True)))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below nodes a and b may be of different groups and sides."""
        grouped = (self.first[a] == self.last[a]) & (self.first[b] == self.last[b]) & (self.first[a] == self.first[b])
        return ~(grouped | ((self.left[a] == self.right[a]) & (self.left[b] == self.right[b]) & (self.left[a] == self.left[b])))


class SignatureTree:
    """``sizes``, ``bitmaps`` (rows of packed bits) and ``groups`` of sets, one entry each; sets of one group need no pair, nor do those of one of ``sides``."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, groups: np.ndarray, sides: np.ndarray | None = None):
        sides = -1 - np.arange(len(sizes)) if sides is None else sides  # below zero: sides of their own
        self.order = np.lexsort((groups, sizes, np.maximum(sides, -1)))
        n, bits, group, side = sizes[self.order].astype(np.int64), bitmaps[self.order].view(np.uint64), groups[self.order], sides[self.order]
        spare = n - np.bitwise_count(bits).sum(axis=1)  # elements that share a bit with another of their set
        self.levels = [Level(bits, n, n, spare, group, group, side, side)]
        while len(self.levels[-1].low) > 1:
            self.levels.append(self.levels[-1].above())

    def _overlaps(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """The largest possible overlap of sets below nodes a and b; -1 where sizes, groups or that overlap rule the similarity out."""
        own = self.levels[level]
        ok = (100 * own.high[a] >= percent * own.low[b]) & (100 * own.high[b] >= percent * own.low[a]) & own.apart(a, b)
        out = np.full(len(a), -1, np.int64)
        k = np.flatnonzero(ok)
        out[k] = largest_overlap(own.bits, own.spare, own.high, a[k], b[k])
        out[(100 + percent) * out < percent * (own.low[a] + own.low[b])] = -1
        return out

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions (in the order given to the tree) of all pairs whose similarity may be ``percent`` or more, and their largest overlaps: ``_CHUNK`` at most at a time."""
        top = len(self.levels) - 1
        waiting = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(FANOUT)
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > _CHUNK:
                waiting += [(level, a[_CHUNK:], b[_CHUNK:]), (level, a[:_CHUNK], b[:_CHUNK])]
                continue
            overlap = self._overlaps(level, a, b, percent)
            # a node with itself: what its own sets have in common is not told by its bitmap
            ok = (a != b) & (overlap >= 0) if not level else (overlap >= 0) | ((a == b) & self.levels[level].apart(a, b))
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if not level:
                yield self.order[a], self.order[b], overlap[ok]
                continue
            below = len(self.levels[level - 1].low)
            x = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            keep = (x <= y) & (x < below) & (y < below)
            waiting.append((level - 1, x[keep], y[keep]))


def largest_overlap(bits: np.ndarray, spare: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An element in both sets has its bit in both bitmaps; beyond one element a bit, a set has ``spare`` at most."""
    overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64) + np.minimum(spare[a], spare[b])
    return np.minimum(overlap, np.minimum(sizes[a], sizes[b]))


def close_pairs(sizes: np.ndarray, bitmaps: np.ndarray, groups: np.ndarray, cell: np.ndarray, percent: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree's test for many trees of one leaf at once: pairs of entries with equal ``cell`` (entries are sorted by it), and their largest overlaps."""
    n, bits = sizes.astype(np.int64), bitmaps.view(np.uint64)
    spare = n - np.bitwise_count(bits).sum(axis=1)
    found = [(np.zeros(0, np.int64),) * 3]
    for step in range(1, len(n)):
        near = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(near):
            break
        for i in range(0, len(near), _CHUNK):
            a, b = near[i : i + _CHUNK], near[i : i + _CHUNK] + step
            keep = (groups[a] != groups[b]) & (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
            if sides is not None:
                keep &= sides[a] != sides[b]
            a, b = a[keep], b[keep]
            overlap = largest_overlap(bits, spare, n, a, b)
            keep = (100 + percent) * overlap >= percent * (n[a] + n[b])
            found.append((a[keep], b[keep], overlap[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class BestPartners:
    """The most similar partner so far of each of some sets, fed with pairs piece by piece; of equally similar ones the first set."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.like, self.partner = sizes.astype(np.int64), np.full(len(sizes), -1.0), np.full(len(sizes), -1, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> None:
        like = np.tile(overlap / (self.sizes[a] + self.sizes[b] - overlap), 2)
        entry, partner = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((partner, -like, entry))
        entry, partner, like = entry[order], partner[order], like[order]
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        entry, partner, like = entry[first], partner[first], like[first]
        better = (like > self.like[entry]) | ((like == self.like[entry]) & (partner < self.partner[entry]))
        self.like[entry[better]], self.partner[entry[better]] = like[better], partner[better]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pair that is the best of one of its sets, once."""
        own = np.flatnonzero(self.partner >= 0)
        low, high = np.minimum(own, self.partner[own]), np.maximum(own, self.partner[own])
        return tuple(np.unique(np.stack([low, high]), axis=1))


def alike(bitmaps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bitmaps of pairs share more than chance: at least half of what they could share beyond it."""
    bits = bitmaps.view(np.uint64)
    x, y = (np.bitwise_count(bits[k]).sum(axis=1).astype(float) for k in (a, b))
    shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1)
    chance = x * y / (bitmaps.shape[1] * 8)
    return shared - chance >= 0.5 * (np.minimum(x, y) - chance)
