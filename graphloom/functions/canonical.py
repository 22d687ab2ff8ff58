"""Colour refinement of one small graph, forms that isomorphic graphs mostly share, and the exact test for two graphs.

A graph is (labels, edges): a label a node, and (u, v, label) with u < v."""

from __future__ import annotations

import hashlib
from collections import Counter

Graph = tuple[list[int], list[tuple[int, int, int]]]


def _near(n: int, edges) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for u, v, label in edges:
        out[u].append((v, label))
        out[v].append((u, label))
    return out


def refine(near: list[list[tuple[int, int]]], colour: list[int]) -> tuple[list[int], Counter]:
    """The coarsest stable colouring under `colour`, numbered alike in isomorphic graphs, and what tells its colours."""
    kinds = len(set(colour))
    while True:
        told = [(c, tuple(sorted((colour[j], label) for j, label in near[i]))) for i, c in enumerate(colour)]
        rank = {t: k for k, t in enumerate(sorted(set(told)))}
        colour = [rank[t] for t in told]
        if len(rank) == kinds:
            return colour, Counter(told)
        kinds = len(rank)


def _apart(colour: list[int], c: int, nodes: set[int]) -> list[int]:
    """Colours in which `nodes`, of colour c, come before the rest of c."""
    return [2 * x + (x == c and i not in nodes) for i, x in enumerate(colour)]


def invariant(graph: Graph) -> str:
    """Equal for isomorphic graphs: a hash of the stable colouring."""
    labels, edges = graph
    _, told = refine(_near(len(labels), edges), list(labels))
    return hashlib.blake2b(repr((sorted(labels), sorted(told.items()))).encode(), digest_size=16).hexdigest()


def form(graph: Graph) -> Graph:
    """The graph with its nodes in the order of their colours; of equal colours the first node goes ahead and all are refined
    again. Equal forms are isomorphic; isomorphic graphs have equal forms where nodes of a colour can be exchanged."""
    labels, edges = graph
    near = _near(len(labels), edges)
    colour, _ = refine(near, list(labels))
    while len(set(colour)) < len(labels):
        c = min(x for x, n in Counter(colour).items() if n > 1)
        colour, _ = refine(near, _apart(colour, c, {colour.index(c)}))
    place = {i: k for k, i in enumerate(sorted(range(len(labels)), key=colour.__getitem__))}
    moved = sorted((min(place[u], place[v]), max(place[u], place[v]), label) for u, v, label in edges)
    return [labels[i] for i in place], moved


def isomorphic(a: Graph, b: Graph) -> bool:
    """Exact: both are coloured together; while a colour has several nodes, one of a's is matched with each of b's in turn."""
    n = len(a[0])
    if sorted(a[0]) != sorted(b[0]) or len(a[1]) != len(b[1]):
        return False
    near = _near(2 * n, [*a[1], *((u + n, v + n, label) for u, v, label in b[1])])
    goal = {(u, v, label) for u, v, label in b[1]}

    def match(colour: list[int]) -> bool:
        colour, _ = refine(near, colour)
        left, right = Counter(colour[:n]), Counter(colour[n:])
        if left != right:
            return False
        open_ = [c for c, k in left.items() if k > 1]
        if not open_:
            to = {c: i for i, c in enumerate(colour[n:])}
            image = [to[c] for c in colour[:n]]
            return {(min(image[u], image[v]), max(image[u], image[v]), label) for u, v, label in a[1]} == goal
        c = min(open_, key=lambda x: (left[x], x))
        first = colour.index(c)
        return any(match(_apart(colour, c, {first, n + j})) for j in range(n) if colour[n + j] == c)

    return match([*a[0], *b[0]])
