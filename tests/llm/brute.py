"""Contracts in plain Python, to test against."""

from __future__ import annotations

import hashlib
import re


def contamination(text: str | None, items: list[tuple[object, str | None]], n: int = 10) -> tuple[int, int, int, str, bool]:
    """The contract by plain Python, for tests."""
    def words(x: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
