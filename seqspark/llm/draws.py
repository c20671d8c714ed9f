"""Exact draws for count matrices: hypergeometric by inversion from the mode, and its multivariate forms."""

from __future__ import annotations

import math
import random


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken from good + bad without replacement are good; steps grow with the spread only."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = right = mode
    p_left = p_right = total = p
    u = rng.random()
    while u >= total and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            total += p_right
            if u < total:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            total += p_left
            if u < total:
                return left
    return mode


def split(rng: random.Random, counts: list[int], draws: int) -> list[int]:
    """Multivariate hypergeometric: how a draw without replacement divides over kinds with these counts."""
    out, rest = [], sum(counts)
    for n in counts:
        rest -= n
        out.append(hypergeometric(rng, n, rest, draws))
        draws -= out[-1]
    return out


def matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform shuffle of all items would make them."""
    left, out = list(columns), []
    for n in rows:
        out.append(split(rng, left, n))
        left = [a - b for a, b in zip(left, out[-1], strict=True)]
    return out


def tree(rng: random.Random, counts: list[int], capacities: list[int]) -> list[list[int]]:
    """Quotas of every kind in every leaf: each node splits its counts between the two halves of its leaves."""
    if len(capacities) == 1:
        return [[n] for n in counts]
    half = len(capacities) // 2
    left = split(rng, counts, sum(capacities[:half]))
    right = [n - x for n, x in zip(counts, left, strict=True)]
    a, b = tree(rng, left, capacities[:half]), tree(rng, right, capacities[half:])
    return [x + y for x, y in zip(a, b, strict=True)]


def even(total: int, parts: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [total // parts + (i < total % parts) for i in range(parts)]
