"""Density clustering of one slab: mutual-reachability tree, condensed, by excess of mass."""

from __future__ import annotations

import numpy as np


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by differences, a dimension at a time: exact zeros and symmetry,
    and no array of three dimensions."""
    out = np.zeros((len(a), len(b)))
    diff = np.empty_like(out)
    for k in range(a.shape[1]):
        np.subtract(a[:, k, None], b[None, :, k], out=diff)
        np.multiply(diff, diff, out=diff)
        out += diff
    return out


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(a, b))


#: Distances held at once where each row needs all of its own.
HELD = 4_000_000


def blocks(x: np.ndarray, y: np.ndarray, take, held: int = HELD) -> np.ndarray:
    """``take`` of the distances of rows of ``x`` to all of ``y``, a block of rows at a time; copied, since a view would hold its block."""
    step = max(1, held // max(1, len(y)))
    return np.concatenate([np.array(take(pairwise(x[i : i + step], y))) for i in range(0, len(x), step)])


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Rows (weight, a, b) of a minimum spanning tree under mutual reachability (Prim), by weight.  A row's distances are
    found when it joins, so memory grows with the rows, not their square."""
    n, columns = len(x), np.ascontiguousarray(x.T)

    def reach(j: int) -> np.ndarray:
        out = np.zeros(n)
        for k, column in enumerate(columns):
            diff = column - x[j, k]
            out += diff * diff
        return np.maximum(np.sqrt(out), np.maximum(core, core[j]))

    best, via, todo = reach(0), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    todo[0] = False
    rows = np.empty((n - 1, 3))
    for k in range(n - 1):
        j = int(np.where(todo, best, np.inf).argmin())
        rows[k] = best[j], via[j], j
        todo[j] = False
        far = reach(j)
        closer = todo & (far < best)
        best[closer], via[closer] = far[closer], j
    return rows[np.argsort(rows[:, 0], kind="stable")]


def density_clusters(x: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Labels 0.. of dense clusters of at least ``least`` rows, -1 for noise; one cluster may be all."""
    n = len(x)
    if n < 2:
        return np.zeros(n, dtype=int)
    at = min(samples, n) - 1
    tree = _spanning_tree(x, blocks(x, x, lambda d: np.partition(d, at, axis=1)[:, at]))

    # Merges, as a binary tree over the rows.
    parent = np.arange(2 * n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kids, height, size = np.zeros((n - 1, 2), dtype=int), np.empty(n - 1), np.ones(2 * n - 1, dtype=int)
    for k, (w, a, b) in enumerate(tree):
        a, b = find(int(a)), find(int(b))
        parent[a] = parent[b] = n + k
        kids[k], height[k], size[n + k] = (a, b), w, size[a] + size[b]

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack.extend(kids[i - n])
        return out

    # Condensed tree: a split into two large parts ends a cluster; small parts fall out of it.
    birth, up, mass = [0.0], [-1], [0.0]
    fell, at = np.zeros(n, dtype=int), np.zeros(n)
    deepest = [0.0]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        lam = 1 / height[node - n] if height[node - n] > 0 else np.inf
        parts = kids[node - n]
        big = [p for p in parts if size[p] >= least]
        for p in parts:
            if len(big) == 2:
                mass[c] += (min(lam, 1e300) - birth[c]) * size[p]
                birth.append(lam)
                up.append(c)
                mass.append(0.0)
                deepest.append(0.0)
                stack.append((p, len(birth) - 1))
            elif p in big:
                stack.append((p, c))
            else:
                rows = leaves(p)
                fell[rows], at[rows] = c, lam
                mass[c] += (min(lam, 1e300) - min(birth[c], 1e300)) * len(rows)
        if len(big) != 1:
            deepest[c] = max(deepest[c], lam)
        elif any(p not in big for p in parts):
            deepest[c] = max(deepest[c], lam)
    # Excess of mass: a cluster stands if it outweighs what stands below it.
    m = len(birth)
    chosen, below = np.zeros(m, dtype=bool), np.zeros(m)
    for c in range(m - 1, -1, -1):
        chosen[c] = mass[c] >= below[c]
        if up[c] >= 0:
            below[up[c]] += max(mass[c], below[c])
    owner = np.full(m, -1)
    for c in range(m):  # parents come first
        if up[c] >= 0 and owner[up[c]] >= 0:
            owner[c] = owner[up[c]]
        elif chosen[c]:
            owner[c] = c
    label = owner[fell]
    if (label == 0).all() and owner[0] == 0:  # all is one cluster: its densest rows are the core
        return np.where(at >= deepest[0], 0, -1)
    found = {c: i for i, c in enumerate(sorted({int(c) for c in label} - {-1}))}
    return np.array([found.get(int(c), -1) for c in label])
