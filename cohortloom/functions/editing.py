"""Edit distance for names typed freely."""

from __future__ import annotations


def osa(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap of neighbours), or ``limit + 1`` if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    start = 0
    top = min(len(a), len(b))
    while start < top and a[start] == b[start]:
        start += 1
    enda, endb = len(a), len(b)
    while enda > start and endb > start and a[enda - 1] == b[endb - 1]:
        enda -= 1
        endb -= 1
    a, b = a[start:enda], b[start:endb]
    if not a or not b:
        d = len(a) + len(b)
        return d if d <= limit else limit + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = last[j - 1] + (x != y)
            if last[j] + 1 < d:
                d = last[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row[j] = d
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1] if last[-1] <= limit else limit + 1
