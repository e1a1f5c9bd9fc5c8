"""Places of a few words in a cloud: each goes out on a spiral until it hits no other."""

from __future__ import annotations

import math


def placed_words(counts: list[tuple[str, int]], small: float = 14.0, large: float = 64.0) -> list[tuple[str, float, float, float]]:
    """(word, size, x, y) of words that are given with their counts, the most frequent first."""
    if not counts:
        return []
    least, most = math.sqrt(counts[-1][1]), math.sqrt(counts[0][1])
    placed: list[tuple[float, float, float, float]] = []
    out = []
    for word, count in counts:
        size = (small + large) / 2 if most == least else small + (large - small) * (math.sqrt(count) - least) / (most - least)
        wide, high = 0.6 * size * len(word), 1.2 * size
        step = 0
        while True:
            turn = 0.35 * step
            x, y = 2.2 * turn * math.cos(turn), 1.4 * turn * math.sin(turn)
            if all(abs(x - a) * 2 >= wide + w or abs(y - b) * 2 >= high + h for a, b, w, h in placed):
                break
            step += 1
        placed.append((x, y, wide, high))
        out.append((word, size, x, y))
    return out
