"""BK-trees over 64-bit fingerprints: children are keyed by their integer Hamming distance to the parent.

Many trees are kept side by side in flat arrays, and building and searching go level by
level over all of them at once, so a task with many small shards costs a few array operations.
"""

from __future__ import annotations

import numpy as np

EDGE = 65  # distances 0..64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree per value of `tree`; (tree, fingerprint) pairs must be distinct."""

    def __init__(self, tree: np.ndarray, prints: np.ndarray) -> None:
        n = len(prints)
        self.prints = prints
        parent_edge = np.full(n, -1, np.int64)  # parent * EDGE + distance, -1 at roots
        left, slot = np.arange(n), tree.astype(np.int64)
        at_root = True
        while len(left):
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            node = left[first]
            if at_root:
                self.trees, self.roots = tree[node], node
            else:
                parent_edge[node] = slot[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            above = node[group[rest]]
            left = left[rest]
            slot = above * EDGE + distance(prints[left], prints[above])
            at_root = False
        self.children = np.argsort(parent_edge, kind="stable")
        self.keys = parent_edge[self.children]

    def search(self, tree: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of every node within the radius; only edges within the radius are followed."""
        place = np.searchsorted(self.trees, tree)
        inside = (place < len(self.trees)) & (self.trees[np.minimum(place, len(self.trees) - 1)] == tree)
        query = np.flatnonzero(inside)
        node = self.roots[place[query]]
        found = []
        while len(query):
            d = distance(prints[query], self.prints[node])
            near = d <= radius
            found.append((query[near], node[near], d[near]))
            low = np.searchsorted(self.keys, node * EDGE + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * EDGE + np.minimum(d + radius, EDGE - 1), "right")
            width = high - low
            query = np.repeat(query, width)
            step = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
            node = self.children[np.repeat(low, width) + step]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
