"""A small decision tree for numeric features (Gini impurity), trained in the process."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def _gini(labels: Sequence[str]) -> float:
    n = len(labels)
    return 1.0 - sum((c / n) ** 2 for c in Counter(labels).values())


def fit(rows: Sequence[Sequence[float]], labels: Sequence[str], max_depth: int = 12, least: int = 1):
    """A nested tuple (feature, threshold, left, right), or a label at a leaf. Ties go to the lower feature."""
    if max_depth == 0 or len(set(labels)) == 1 or len(rows) < 2 * least:
        return min(Counter(labels).items(), key=lambda x: (-x[1], x[0]))[0]
    best, base = None, _gini(labels)
    for f in range(len(rows[0])):
        cuts = sorted({r[f] for r in rows})
        for a, b in zip(cuts, cuts[1:]):
            t = (a + b) / 2
            left = [y for r, y in zip(rows, labels) if r[f] <= t]
            right = [y for r, y in zip(rows, labels) if r[f] > t]
            if min(len(left), len(right)) < least:
                continue
            gain = base - (len(left) * _gini(left) + len(right) * _gini(right)) / len(labels)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, t)
    if best is None or best[0] <= 1e-12:
        return min(Counter(labels).items(), key=lambda x: (-x[1], x[0]))[0]
    _, f, t = best
    parts = ([(r, y) for r, y in zip(rows, labels) if r[f] <= t], [(r, y) for r, y in zip(rows, labels) if r[f] > t])
    sides = [fit([r for r, _ in p], [y for _, y in p], max_depth - 1, least) for p in parts]
    return (f, t, sides[0], sides[1])


def predict(tree, row: Sequence[float]) -> str:
    while not isinstance(tree, str):
        f, t, left, right = tree
        tree = left if row[f] <= t else right
    return tree
