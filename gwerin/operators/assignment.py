"""Optimal assignment of the rows of a small cost matrix to its columns."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment (Hungarian method); rows beyond the columns get -1."""
    n, m = cost.shape
    if n > m:
        back = assign(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = at
            nxt = int(np.argmin(np.where(used, np.inf, np.r_[np.inf, least[1:]])))
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nxt
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
