"""Cutting-stock linear program by column generation, on a histogram of item sizes.

Items of integer sizes go into bins of one capacity; a pattern says how many items of each
size a bin holds. The linear program (fewest bins that hold the demands) starts from patterns
of one size each. A knapsack dynamic program prices new patterns with the current duals; the
simplex step swaps one in. It ends when no pattern improves, or when the value lies within
``gap`` of a bound: the items' volume, or what the last pricing proves.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-9
GAP = 2e-3


def price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest dual value that fits, by an unbounded-knapsack program."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    reach = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = reach[c]
        if k:
            values = best[c - sizes[:k]] + duals[:k]
            at = int(values.argmax())
            if values[at] > best[c] + EPS:
                best[c], last[c] = values[at], at
    pattern = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demands: np.ndarray, capacity: int, gap: float = GAP,
          max_rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, one per row; how many bins of each), a basic solution of the linear program.

    ``sizes`` ascend, each at most ``capacity``; all ``demands`` are over 0. After
    ``max_rounds`` (40 a size by default) the solution at hand, feasible like any, is returned.
    """
    m = len(sizes)
    if m == 0:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    basis = np.diag(capacity // sizes).astype(np.int64)  # columns are patterns
    costs = np.ones(m)
    inverse = np.diag(1.0 / np.diag(basis))
    x = demands / np.diag(basis)
    volume = float(sizes @ demands) / capacity
    for _ in range(max_rounds or 40 * m):
        duals = costs @ inverse
        spare = int(duals.argmin())
        if duals[spare] < -EPS:
            column, cost = np.zeros(m, np.int64), 0.0
            column[spare] = -1  # a surplus of this size costs nothing
        else:
            value, column = price(sizes, duals, capacity)
            total = float(costs @ x)
            if value <= 1 + EPS or total <= (1 + gap) * max(volume, total / value):
                break
            cost = 1.0
        step = inverse @ column
        ratios = np.where(step > EPS, x / np.where(step > EPS, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        theta = ratios[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out], costs[out] = column, cost
    used = costs > 0
    return basis.T[used], x[used]


def rounded(patterns: np.ndarray, x: np.ndarray, demands: np.ndarray) -> np.ndarray:
    """Whole numbers of bins: the floors, then once more by falling fraction where items are left
    for every place of the pattern."""
    times = np.floor(x + 1e-6).astype(np.int64)
    left = demands - times @ patterns if len(patterns) else demands.copy()
    for p in np.argsort(-(x - times), kind="stable"):
        while (patterns[p] <= left).all() and patterns[p].any() and x[p] > times[p] - 1 + EPS:
            times[p] += 1
            left = left - patterns[p]
    return times
