"""Edit distance with adjacent transpositions (each place edited once)."""

from __future__ import annotations


def osa(a: str, b: str, most: int = 99) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` where it exceeds ``most``."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    before: list[int] = []
    row = list(range(lb + 1))
    for i in range(1, la + 1):
        new = [i] + [0] * lb
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cb = b[j - 1]
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < best:
                best = before[j - 2] + 1
            new[j] = best
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[lb], most + 1)


_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (r, i + 0.5 * r) for r, line in enumerate(_ROWS) for i, c in enumerate(line)}


def neighbours(a: str, b: str) -> bool:
    """Whether two letters lie side by side on a keyboard."""
    if a not in _AT or b not in _AT:
        return False
    (r, x), (s, y) = _AT[a], _AT[b]
    return a != b and abs(r - s) <= 1 and abs(x - y) <= 1.0


def one_typo(a: str, b: str) -> bool:
    """One slip of the fingers: a doubled, dropped, swapped or neighbouring key, or a stray letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) != len(b):
        s, t = (a, b) if len(a) < len(b) else (b, a)
        return s[i:] == t[i + 1 :]
    if a[i + 1 :] == b[i + 1 :]:
        return neighbours(a[i], b[i])
    return a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
