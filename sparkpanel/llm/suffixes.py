"""Deep-shallow ordering of byte strings.

Multikey quicksort, eight bytes at a time, orders all strings down to a shallow depth; groups that are still tied
there share a long prefix and are ordered by a blind (Patricia) trie, which looks at branching bytes only and
compares once in full per insertion.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SHALLOW = 48


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings of one length, ordered by insertion into a trie of branching positions."""

    def __init__(self, first: bytes):
        self.root: tuple | bytes = first  # a leaf is its string; an inner node is (position, {byte: child})

    def add(self, new: bytes) -> None:
        node, leaf = self.root, self.root
        while not isinstance(leaf, bytes):
            at, children = leaf
            leaf = children.get(new[at]) or next(iter(children.values()))
        split = common(leaf, new)
        if split == len(new):
            return
        parent, key = None, None
        while not isinstance(node, bytes) and node[0] < split:
            parent, key = node, new[node[0]]
            node = node[1][key]
        if not isinstance(node, bytes) and node[0] == split:
            node[1][new[split]] = new
            return
        fresh = (split, {leaf[split]: node, new[split]: new})
        if parent is None:
            self.root = fresh
        else:
            parent[1][key] = fresh

    def ordered(self):
        """Each string with the length that it shares with the one before."""
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, bytes):
                yield node, shared
                continue
            at, children = node
            keys = sorted(children)
            stack.extend((children[k], at) for k in reversed(keys[1:]))
            stack.append((children[keys[0]], shared))


def deep_shallow(bucket: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a uint8 matrix within buckets, and each row's common prefix with the one before it.

    A row that begins a bucket has -1. Equal rows of a bucket stand together with the full width between them.
    """
    n, width = strings.shape
    order = np.argsort(bucket, kind="stable")
    shared = np.full(n, -1, dtype=np.int64)
    same = np.r_[False, bucket[order][1:] == bucket[order][:-1]] if n else np.zeros(0, dtype=bool)
    shallow = min(SHALLOW, -(-width // 8) * 8)
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = strings
    keys = padded[:, :shallow].copy().view(">u8").astype(U)
    for depth in range(shallow // 8):  # same[i]: row i and the one before are tied so far
        tied = same | np.r_[same[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        column = keys[order[at], depth]
        inner = np.lexsort((column, group))
        order[at] = order[at[inner]]
        column = column[inner]
        parts = np.r_[False, (group[1:] == group[:-1]) & (column[1:] != column[:-1])]
        if parts.any():
            here = np.flatnonzero(parts)
            differ = column[here] ^ column[here - 1]
            lead = sum((differ < U(1 << (8 * (7 - j)))).astype(np.int64) for j in range(7))  # equal leading bytes
            shared[at[here]] = np.minimum(depth * 8 + lead, width)
            same[at[here]] = False
    heads = np.flatnonzero(~same & np.r_[same[1:], False]) if n else []
    if width <= shallow:
        shared[same] = width
        return order, shared
    for head in heads:
        tail = head + 1
        while tail < n and same[tail]:
            tail += 1
        rows = order[head:tail]
        leaves: dict[bytes, list[int]] = {}
        for r in rows:
            leaves.setdefault(strings[r].tobytes(), []).append(r)
        at = head
        if len(leaves) == 1:
            shared[head + 1 : tail] = width
            continue
        spelled = iter(leaves)
        trie = BlindTrie(next(spelled))
        for s in spelled:
            trie.add(s)
        for s, lcp in trie.ordered():
            members = leaves[s]
            if at > head:
                shared[at] = lcp
            order[at : at + len(members)] = members
            shared[at + 1 : at + len(members)] = width
            at += len(members)
    return order, shared
