"""Best-fit-decreasing bin packing of indivisible items, given as runs of equal sizes.

Remaining capacities are kept in a balanced tree, so the tightest bin that an item fits into is found in logarithmic
time.  Items of one size are interchangeable, and a bin stays the tightest one as it fills; so a run of equal items
goes into a bin at once, and the time depends on distinct sizes and bins, not on items.
"""

from __future__ import annotations

from collections.abc import Iterable


class Capacities:
    """Bins by (remaining capacity, number) in a treap; priorities are hashes of the bin numbers."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(number: int) -> int:
        return (number + 1) * 0x9E3779B97F4A7C15 * 0xD6E8FEB86659FD93 >> 13 & 0xFFFFFFFF

    def add(self, left: int, number: int) -> None:
        key, mine = (left, number), self._priority(number)
        path, node = [], self.root
        while node is not None and node[1] >= mine:
            side = 2 if key < node[0] else 3
            path.append((node, side))
            node = node[side]
        small, large = self._split(node, key)
        fresh = [key, mine, small, large]
        if path:
            path[-1][0][path[-1][1]] = fresh
        else:
            self.root = fresh

    def remove(self, left: int, number: int) -> None:
        key, above, node = (left, number), None, self.root
        while node[0] != key:
            above = (node, 2 if key < node[0] else 3)
            node = node[above[1]]
        joined = self._merge(node[2], node[3])
        if above is None:
            self.root = joined
        else:
            above[0][above[1]] = joined

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(remaining capacity, number) of the bin with the least capacity that is enough; the smaller of equals."""
        found, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found

    @staticmethod
    def _split(node, key):
        """Subtrees of the keys below and above ``key``."""
        ends = [None, None, None, None]
        low, high = (ends, 3), (ends, 2)
        while node is not None:
            if node[0] < key:
                low[0][low[1]] = node
                low, node = (node, 3), node[3]
            else:
                high[0][high[1]] = node
                high, node = (node, 2), node[2]
        low[0][low[1]] = high[0][high[1]] = None
        return ends[3], ends[2]

    @staticmethod
    def _merge(low, high):
        top = [None, None, None, None]
        at, side = top, 2
        while low is not None and high is not None:
            if low[1] >= high[1]:
                at[side] = low
                at, side, low = low, 3, low[3]
            else:
                at[side] = high
                at, side, high = high, 2, high[2]
        at[side] = low if low is not None else high
        return top[2]


def pack(runs: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, count) of ``runs`` (size, count), largest sizes first, in bins of ``capacity`` from 0 on.

    A bin is opened when no open one has room; an item over the capacity has a bin of its own.  None when more than
    ``most`` bins would be needed.
    """
    bins, out, opened = Capacities(), [], 0
    for size, count in sorted(runs, reverse=True):
        while count:
            best = bins.tightest(size)
            if best is None:
                if opened == most:
                    return None
                best, opened = (max(capacity, size), opened), opened + 1
            else:
                bins.remove(*best)
            room, number = best
            fit = min(count, room // size)
            out.append((size, number, fit))
            bins.add(room - fit * size, number)
            count -= fit
    return out


def balance(runs: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, bin, count) of ``runs`` in ``shards`` bins with loads as equal as the items allow.

    Items larger than an equal share of what is left have a bin of their own.  The others are packed best-fit-decreasing
    at the smallest capacity, found by bisection to one part in 2^20, at which they need no more than the bins left.
    """
    left = {}
    for size, count in runs:
        left[size] = left.get(size, 0) + count
    out, first = [], 0
    total = sum(s * c for s, c in left.items())
    for size in sorted(left, reverse=True):
        while left[size] and shards - first > 1 and size * (shards - first) > total:
            out.append((size, first, 1))
            first, left[size], total = first + 1, left[size] - 1, total - size
        if left[size]:
            break
    rest = sorted(((s, c) for s, c in left.items() if c), reverse=True)
    if not rest:
        return out
    free = shards - first
    low = max(rest[0][0], -(-total // free))
    high = low
    while (best := pack(rest, high, free)) is None:
        high += max(1, high // 64)
    while high - low > low >> 20:
        mid = (low + high) // 2
        tried = pack(rest, mid, free)
        if tried is None:
            low = mid + 1
        else:
            best, high = tried, mid
    return out + [(size, number + first, count) for size, number, count in best]
