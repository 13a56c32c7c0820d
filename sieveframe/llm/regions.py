"""One region of the Jaccard join: a tree of Voronoi cells over the region's documents, and exact links within it."""

from __future__ import annotations

import numpy as np

#: Cells of at most this many documents are searched at once; larger ones get pivots of their own.
LEAF = 512
PIVOTS = 8


def shared_with(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct integers."""
    if not len(x) or not len(y):
        return 0
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


class _Index:
    """Documents by shingle: overlaps(x) is the number of shingles that x shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner, self.count = flat[order], owner[order], len(sets)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, dtype=np.int64)
        self.shingles, self.first = flat[first], np.concatenate([first, [len(flat)]])

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.shingles):
            return np.zeros(self.count, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        at = at[self.shingles[at] == x]
        lengths = self.first[at + 1] - self.first[at]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + lengths, lengths)
        return np.bincount(self.owner[places], minlength=self.count)


def _distances(shared: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 1 - shared / (sizes + n - shared)


class _Cell:
    """Documents ``at`` of a region, with pivots, their Voronoi cells and radii unless there are few."""

    def __init__(self, region: Region, at: np.ndarray):
        self.at, self.children = at, []
        index = _Index([region.sets[i] for i in at])
        if len(at) <= region.leaf:
            self.index = index
            return
        sizes, pivot, nearest, owner, pivots = region.sizes[at], 0, None, None, []
        for k in range(PIVOTS):  # each next pivot is the document farthest from those there are
            away = _distances(index.overlaps(region.sets[at[pivot]]), sizes[pivot], sizes)
            pivots.append(at[pivot])
            if nearest is None:
                nearest, owner = away, np.zeros(len(at), dtype=np.int64)
            else:
                closer = away < nearest
                nearest, owner = np.where(closer, away, nearest), np.where(closer, k, owner)
            pivot = int(np.argmax(nearest))
            if nearest[pivot] <= 0:
                break
        groups = [(p, at[owner == k], nearest[owner == k]) for k, p in enumerate(pivots)]
        if max(len(g) for _, g, _ in groups) > 0.9 * len(at):  # pivots do not tell these apart
            self.index = index
            return
        self.index = None
        self.children = [(p, float(d.max()), _Cell(region, g)) for p, g, d in groups if len(g)]


class Region:
    """Links of documents (sorted shingles, sizes of their whole sets) with those of one region.

    Sets may lack shingles that no other document has; ``sizes`` counts those too.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int, leaf: int = LEAF):
        self.sets, self.sizes, self.percent, self.leaf = sets, sizes.astype(np.int64), percent, leaf
        self.top = _Cell(self, np.arange(len(sets)))

    def partners(self, x: np.ndarray, n: int) -> np.ndarray:
        """The documents of the region that are linked with the set x of whole size n."""
        reach = (100 - self.percent) / 100 + 1e-9
        found, cells = [], [self.top]
        while cells:
            cell = cells.pop()
            if cell.index is not None:
                shared, sizes = cell.index.overlaps(x), self.sizes[cell.at]
                found.append(cell.at[100 * shared >= self.percent * (sizes + n - shared)])
                continue
            away = [1 - (k := shared_with(x, self.sets[p])) / (self.sizes[p] + n - k) for p, _, _ in cell.children]
            # A partner is within reach of x: in a cell no farther than its radius and reach allow, and, as it is
            # nowhere nearer to another pivot than to its own, no farther than twice the reach behind the nearest.
            window = min(away) + 2 * reach
            cells += [child for d, (_, radius, child) in zip(away, cell.children) if d <= min(window, radius + reach)]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
