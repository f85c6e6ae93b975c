"""BK-trees over 64-bit fingerprints: children hang at their integer Hamming distance to the parent.

A search for radius r that stands at distance d from a node only follows the edges d - r to d + r (triangle inequality).
Many small trees (one for each bucket) are built and searched together with arrays, one tree level at a time.
"""

from __future__ import annotations

import numpy as np

#: (query, node) pairs held at once while searching.
FRONTIER = 2_000_000
WIDTH = 65  # distances 0 to 64


class BKForest:
    """One BK-tree for each bucket. ``values`` are uint64, distinct inside a bucket; ``buckets`` are sorted integers."""

    def __init__(self, values: np.ndarray, buckets: np.ndarray):
        n = len(values)
        self.values = values
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, n])
        self.root = np.repeat(starts, sizes)
        edge_keys, children = [], []
        # ``open`` elements hang somewhere below ``above``; the first of each (above, distance) becomes the child there.
        opened = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        above = self.root[opened]
        while len(opened):
            distance = np.bitwise_count(values[opened] ^ values[above]).astype(np.int64)
            key = above * WIDTH + distance
            order = np.argsort(key, kind="stable")
            opened, key = opened[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = opened[first]
            edge_keys.append(key[first])
            children.append(child)
            below = child[np.cumsum(first) - 1]
            opened, above = opened[~first], below[~first]
        keys = np.concatenate(edge_keys) if edge_keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def hits(self, radius: int):
        """Blocks of (query, node) index pairs at most ``radius`` apart, each pair once and no element with itself."""
        todo = [(np.arange(len(self.values)), self.root)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = (distance <= radius) & (node < query)
            if near.any():
                yield query[near], node[near]
            base = node * WIDTH
            low = np.searchsorted(self.edges, base + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, base + np.minimum(distance + radius, WIDTH - 1), side="right")
            width = high - low
            some = width > 0
            query, low, width = query[some], low[some], width[some]
            if len(query):
                step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                below = self.children[np.repeat(low, width) + step]
                query = np.repeat(query, width)
                # Every unordered pair is met from its later element: a search need not pass its own place in the order
                # of building, where all that hang below a node come after it.
                open_ = below < query
                todo.append((query[open_], below[open_]))

    def roots(self, radius: int) -> np.ndarray:
        """For each element the smallest index of its component under links of at most ``radius``; links are not kept."""
        parent = np.arange(len(self.values))
        for query, node in self.hits(radius):
            parent = joined(parent, query, node)
        return flat(parent)


def flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of a and b pair by pair: larger roots hook onto smaller ones until every pair agrees."""
    while True:
        parent = flat(parent)
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return parent
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
