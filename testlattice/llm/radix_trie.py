"""A byte trie whose edges carry strings and whose leaves carry counters; tries merge, travel as bytes, and are walked in byte order.

Byte order of UTF-8 is the order of code points, so a walk meets the terms of a text in their sorted order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np


class Leaf:
    """How many documents hold a term, and how often it occurs in each source."""

    __slots__ = ("docs", "counts")

    def __init__(self, docs: int = 0, counts: dict[int, int] | None = None):
        self.docs, self.counts = docs, counts if counts is not None else {}

    def add(self, other: Leaf) -> None:
        self.docs += other.docs
        for source, n in other.counts.items():
            self.counts[source] = self.counts.get(source, 0) + n


class Node:
    __slots__ = ("edges", "leaf")

    def __init__(self, leaf: Leaf | None = None):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.leaf = leaf

    def leaves(self) -> int:
        """Leaves of this node and below."""
        n, todo = 0, [self]
        while todo:
            node = todo.pop()
            n += node.leaf is not None
            if node.edges:
                todo += [child for _, child in node.edges.values()]
        return n


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if n < 32:
        return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)  # noqa: B905
    low, high = 0, n  # a[:low] equals b[:low], a[:high] doesn't equal b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


#: Codes of signed numbers by their bytes.
_CODES = {array(c).itemsize: c for c in "bhiq"}


def _bytes(shape: list[int], labels: list[bytes], docs: list[int], sources: list[int], values: list[int]) -> tuple[bytes, list[int]]:
    """The bytes of a trie whose nodes, leaves and counters are listed in the order of the walk; and the sources that the counters name."""
    known = sorted(set(sources))
    places = {x: i for i, x in enumerate(known)}
    parts, head = [], []
    for x in (shape, docs, [places[s] for s in sources], values):
        most = max(x, default=0)
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
        parts.append(array(_CODES[width], x).tobytes())
        head += (len(x), width)
    return b"".join([array("q", head).tobytes(), *parts, *labels]), known


def packed_sorted(keys: list[bytes], docs: list[int], counts: list[list[int]]) -> tuple[bytes, list[int]]:
    """What ``Trie.of_sorted(...).packed()`` gives for distinct keys in byte order, without making the nodes.

    ``counts`` has a source and its counter in turn. The keys below a node are a range, whose first and last key have in common what the node has.
    """
    shape: list[int] = []
    labels, met, sources, values = [], [], [], []
    todo = [(0, len(keys), 0, True)]
    while todo:
        low, high, start, root = todo.pop()
        key = keys[low]
        if high - low == 1 and not root:
            own = counts[low]
            shape += (len(key) - start, 0, len(own) >> 1)
            labels.append(key[start:])
            met.append(docs[low])
            sources += own[::2]
            values += own[1::2]
            continue
        end = 0 if root else start + _common(key[start:], keys[high - 1][start:]) if key != keys[high - 1] else len(key)
        held = -1
        labels.append(key[start:end])
        if len(key) == end:
            own = counts[low]
            held = len(own) >> 1
            met.append(docs[low])
            sources += own[::2]
            values += own[1::2]
            low += 1
        below = []
        while low < high:
            first = keys[low][end]
            next_ = low + 1
            while next_ < high and keys[next_][end] == first:
                next_ += 1
            below.append((low, next_, end, False))
            low = next_
        shape += (end - start, len(below), held)
        todo += reversed(below)
    return _bytes(shape, labels, met, sources, values)


class Trie:
    def __init__(self) -> None:
        self.root = Node()
        self.size = 0

    @classmethod
    def of_sorted(cls, items: Iterable[tuple[bytes, Leaf]]) -> Trie:
        """The trie of distinct keys that come in byte order: only the branch of the last key is touched by the next."""
        out, last = cls(), b""
        branch = [(out.root, 0)]  # the nodes on the way to the last key, with the lengths of their keys
        for key, leaf in items:
            n = _common(last, key)
            while branch[-1][1] > n:
                branch.pop()
            node, depth = branch[-1]
            if depth < n:
                label, child = node.edges[last[depth]]
                middle = Node()
                middle.edges[label[n - depth]] = (label[n - depth :], child)
                node.edges[last[depth]] = (label[: n - depth], middle)
                node = middle
                branch.append((node, n))
            if n < len(key):
                end = Node()
                node.edges[key[n]] = (key[n:], end)
                node = end
                branch.append((node, len(key)))
            node.leaf, last, out.size = leaf, key, out.size + 1
        return out

    def leaf(self, key: bytes) -> Leaf:
        """The leaf of a key, made where there is none."""
        node = self._node(self.root, key)
        if node.leaf is None:
            node.leaf = Leaf()
            self.size += 1
        return node.leaf

    def _node(self, node: Node, key: bytes) -> Node:
        """The node that a key leads to from ``node``; edges are made and divided on the way."""
        while key:
            edge = node.edges.get(key[0])
            if edge is None:
                end = Node()
                node.edges[key[0]] = (key, end)
                return end
            label, child = edge
            if key.startswith(label):
                node, key = child, key[len(label) :]
                continue
            n = _common(label, key)
            middle = Node()
            middle.edges[label[n]] = (label[n:], child)
            node.edges[key[0]] = (key[:n], middle)
            node, key = middle, key[n:]
        return node

    def merge(self, other: Trie, below: bytes = b"") -> None:
        """Take in all that another trie has, under a prefix; the other isn't to be used afterwards."""
        todo = [(self._node(self.root, below), other.root)]
        while todo:
            own, new = todo.pop()
            if new.leaf is not None:
                if own.leaf is None:
                    own.leaf = new.leaf
                    self.size += 1
                else:
                    own.leaf.add(new.leaf)
            for first, (label, child) in new.edges.items():
                if first in own.edges:
                    todo.append((self._node(own, label), child))
                else:  # nothing to merge with: the branch is taken as it is
                    own.edges[first] = (label, child)
                    self.size += child.leaves()

    def walk(self) -> Iterator[tuple[bytes, Leaf]]:
        """Keys in byte order, with their leaves."""
        todo = [(b"", self.root)]
        while todo:
            key, node = todo.pop()
            if node.leaf is not None:
                yield key, node.leaf
            for first in sorted(node.edges, reverse=True):
                label, child = node.edges[first]
                todo.append((key + label, child))

    def keep(self, least: int) -> None:
        """Drop the leaves of keys that fewer documents hold, and the branches that lead to none."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += [child for _, child in node.edges.values()]
        for node in reversed(order):
            if node.leaf is not None and node.leaf.docs < least:
                node.leaf = None
                self.size -= 1
            node.edges = {f: (label, child) for f, (label, child) in node.edges.items() if child.leaf is not None or child.edges}

    def packed(self) -> tuple[bytes, list[int]]:
        """The trie as bytes: nodes in the order of the walk, with their edge, number of edges and counters; and the sources that its counters name."""
        shape, labels, leaves, sources, values = [], [], [], [], []
        todo = [(b"", self.root)]
        while todo:
            label, node = todo.pop()
            shape += (len(label), len(node.edges), -1 if node.leaf is None else len(node.leaf.counts))
            labels.append(label)
            if node.leaf is not None:
                leaves.append(node.leaf.docs)
                sources += node.leaf.counts
                values += node.leaf.counts.values()
            todo += [node.edges[f] for f in sorted(node.edges, reverse=True)]
        return _bytes(shape, labels, leaves, sources, values)

    @classmethod
    def unpacked(cls, data: bytes, sources: list[int]) -> Trie:
        """The trie of ``packed``, its counters naming ``sources``."""
        sizes = np.frombuffer(data, np.int64, 8).reshape(4, 2)
        at, parts = 64, []
        for n, width in sizes.tolist():
            parts.append(np.frombuffer(data, f"<i{width}", n, at).tolist())
            at += width * n
        shape, leaves, places, values = parts
        out, leaf, entry = cls(), 0, 0
        open_: list[list] = []  # nodes with the number of edges they still miss
        for i in range(0, len(shape), 3):
            length, edges, held = shape[i : i + 3]
            node = out.root if i == 0 else Node()
            if i:
                label = data[at : at + length]
                at += length
                open_[-1][0].edges[label[0]] = (label, node)
                open_[-1][1] -= 1
            if held >= 0:
                counts = {sources[places[entry]]: values[entry]} if held == 1 else {sources[p]: v for p, v in zip(places[entry : entry + held], values[entry : entry + held], strict=True)}
                node.leaf = Leaf(leaves[leaf], counts)
                leaf, entry, out.size = leaf + 1, entry + held, out.size + 1
            if edges:
                open_.append([node, edges])
            while open_ and not open_[-1][1]:
                open_.pop()
        return out
