"""A trie over globally ordered sets, and exact Jaccard links found by traversing it."""

from __future__ import annotations

import numpy as np

#: Two sets link when DEN * |intersection| >= NUM * |union|.
NUM, DEN = 80, 100


def needed(a: int, b, num: int = NUM, den: int = DEN):
    """Smallest intersection that links sets of a and b members."""
    return -(-num * (a + b) // (den + num))


class PrefixTree:
    """Sets in a compressed trie: rare members first, so that paths part early and most subtrees are pruned near the root.

    Members that only one set holds cannot be shared; they leave the paths and count in the sizes alone. A node stands for
    a run of members that all sets below it share; what a probe has in common with the run is counted once for all of them.
    """

    def __init__(self, sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> None:
        self.num, self.den = num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.n)
        member, where, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(member), np.int64)
        rank[np.lexsort((member, count))] = np.arange(len(member))
        shared = count[where] > 1
        own, rk = owner[shared], rank[where][shared]
        order = np.lexsort((rk, own))
        own, rk = own[order], rk[order]
        ends = np.searchsorted(own, np.arange(len(sets) + 1))
        self.paths = [rk[ends[i] : ends[i + 1]] for i in range(len(sets))]
        self.has = np.zeros(len(member), bool)
        self.row = np.array(sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes()))
        self._grow()

    def _grow(self) -> None:
        paths, row = self.paths, self.row
        lcp = np.zeros(len(row), np.int64)
        for k in range(1, len(row)):
            a, b = paths[row[k - 1]], paths[row[k]]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            lcp[k] = differ.argmax() if differ.any() else m
        size, length = self.n[row], np.array([len(paths[i]) for i in row], np.int64)
        lo, hi, deep, end, parent, runs = [], [], [], [], [], []
        todo = [(0, len(row), 0, -1)]
        while todo:
            a, b, depth, above = todo.pop()
            low = int(lcp[a + 1 : b].min()) if b - a > 1 else int(length[a])
            runs.append(paths[row[a]][depth:low])
            lo.append(a)
            hi.append(b)
            deep.append(depth)
            end.append(low)
            parent.append(above)
            if b - a > 1 and length[a:b].max() > low:
                cuts = [a, *(np.flatnonzero(lcp[a + 1 : b] == low) + a + 1).tolist(), b]
                todo.extend((x, y, low, len(lo) - 1) for x, y in zip(cuts, cuts[1:]))
        self.lo, self.hi, self.end = np.array(lo), np.array(hi), np.array(end)
        lens = np.array([len(r) for r in runs], np.int64)
        self.run = np.concatenate(runs) if len(runs) else np.zeros(0, np.int64)
        self.stop = np.cumsum(lens)
        self.start = self.stop - lens
        self.last = np.array([paths[row[a]][e - 1] if e else -1 for a, e in zip(lo, end)])
        self.least = np.array([size[a:b].min() for a, b in zip(lo, hi)])
        self.most = np.array([size[a:b].max() for a, b in zip(lo, hi)])
        self.longest = np.array([length[a:b].max() for a, b in zip(lo, hi)])
        by = np.argsort(parent, kind="stable")
        edges = np.searchsorted(np.array(parent)[by], np.arange(len(lo) + 1))
        self.children = [by[edges[i] : edges[i + 1]] for i in range(len(lo))]

    def probe(self, i: int) -> np.ndarray:
        """The sets that link with set i, itself among them."""
        x, nx = self.paths[i], int(self.n[i])
        self.has[x] = True
        found = []
        level, before = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(level):
            start, lens = self.start[level], self.stop[level] - self.start[level]
            stops = np.cumsum(lens)
            at = np.arange(stops[-1]) + np.repeat(start - stops + lens, lens)
            total = np.concatenate(([0], np.cumsum(self.has[self.run[at]])))
            common = before + total[stops] - total[stops - lens]
            rest = np.minimum(len(x) - np.searchsorted(x, self.last[level], "right"), self.longest[level] - self.end[level])
            ok = (common + rest >= needed(nx, self.least[level], self.num, self.den)) & (self.den * self.most[level] >= self.num * nx) & (self.num * self.least[level] <= self.den * nx)
            below, had = [], []
            for node, c in zip(level[ok].tolist(), common[ok].tolist()):
                if len(self.children[node]):
                    below.append(self.children[node])
                    had.append(np.full(len(self.children[node]), c))
                else:
                    rows = self.row[self.lo[node] : self.hi[node]]
                    # private members are no one else's, so c is the whole intersection; only x itself shares its own
                    found.append(rows[(self.den * c >= self.num * (nx + self.n[rows] - c)) | (rows == i)])
            level = np.concatenate(below) if below else np.zeros(0, np.int64)
            before = np.concatenate(had) if had else np.zeros(0, np.int64)
        self.has[x] = False
        return np.concatenate([*found, [i]]).astype(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node that each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link(sets: list[np.ndarray], must: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Component (as its smallest index) of each of some distinct sets, so that linked sets share one.

    Sets are probed until those not probed lie in one component: a pair that was never compared is then joined already.
    With `must`, exactly these are probed.
    """
    tree, n = PrefixTree(sets, num, den), len(sets)
    label = np.arange(n)

    def probe(i: int) -> None:
        nonlocal label
        roots = np.unique(label[tree.probe(i)])
        if len(roots) > 1:
            label = np.where(np.isin(label, roots), roots[0], label)

    if must is not None:
        for i in np.flatnonzero(must):
            probe(int(i))
        return label
    open_ = np.ones(n, bool)
    while True:
        left = np.flatnonzero(open_)
        kinds, counts = np.unique(label[left], return_counts=True)
        if len(kinds) < 2:
            return label
        i = int(left[label[left] != kinds[counts.argmax()]][0]) if counts.max() > 1 else int(left[0])
        open_[i] = False
        probe(i)
