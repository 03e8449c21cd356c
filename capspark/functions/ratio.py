"""Whether two texts' Ratcliff-Obershelp ratio is above a bound, as difflib counts it, with numpy and
no further than the answer needs."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np

#: Pairs of equal letters that are listed at once; longer texts go to difflib.
PAIRS = 1 << 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> tuple | None:
    """start in a, start in b, length of the diagonal runs of equal letters that difflib looks up in
    b: of texts of 200 or more those that are not popular there. None if there are too many."""
    seen = (count_b > 0) & (count_b <= len(b) // 100 + 1) if len(b) >= 200 else count_b > 0
    if int(count_a[seen] @ count_b[seen]) > PAIRS:
        return None
    at_a, at_b = np.flatnonzero(seen[a]), np.flatnonzero(seen[b])
    at_b = at_b[np.argsort(b[at_b], kind="stable")]
    first = np.cumsum(np.where(seen, count_b, 0)) - np.where(seen, count_b, 0)
    n = count_b[a[at_a]]
    i = np.repeat(at_a, n)
    j = at_b[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a[at_a]], n)]
    wide = len(a) + 1  # diagonals are apart, so that a run ends where its diagonal does
    key = np.sort((j - i + len(a)) * wide + i)
    new = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    size = np.diff(new, append=len(key))
    i = key[new] % wide
    return i, i + key[new] // wide - len(a), size


def above(x: str, y: str, ratio: float) -> bool:
    """SequenceMatcher(None, x, y).ratio() > ratio."""
    both = len(x) + len(y)
    more = lambda matched: (2.0 * matched / both if both else 1.0) > ratio
    if not more(min(len(x), len(y))):
        return False
    if x == y:
        return True
    a, b = _codes(x), _codes(y)
    if max(a.max(initial=0), b.max(initial=0)) >= 4096:
        _, a = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = a[: len(x)], a[len(x) :]
    letters = int(max(a.max(initial=0), b.max(initial=0))) + 1
    count_a, count_b = np.bincount(a, minlength=letters), np.bincount(b, minlength=letters)
    if not more(int(np.minimum(count_a, count_b).sum())):
        return False
    runs = _runs(a, b, count_a, count_b)
    if runs is None:
        return SequenceMatcher(None, x, y).ratio() > ratio
    # difflib's blocks, those of the widest open ranges first; room: what open ranges can add at most
    matched, room = 0, min(len(x), len(y))
    ranges = [(-room, 0, len(x), 0, len(y), *runs)]
    while ranges:
        _, a0, a1, b0, b1, i, j, size = heapq.heappop(ranges)
        room -= min(a1 - a0, b1 - b0)
        cut = np.maximum(np.maximum(a0 - i, b0 - j), 0)
        i, j, size = i + cut, j + cut, size - cut
        size = np.minimum(size, np.minimum(a1 - i, b1 - j))
        inside = size > 0
        i, j, size = i[inside], j[inside], size[inside]
        p, q, n = a0, b0, 0
        if len(size):
            n = int(size.max())
            longest = np.flatnonzero(size == n)
            k = longest[np.lexsort((j[longest], i[longest]))[0]]
            p, q = int(i[k]), int(j[k])
        back = min(p - a0, q - b0)
        if back:
            other = np.flatnonzero(a[p - back : p] != b[q - back : q])
            back -= int(other[-1]) + 1 if len(other) else 0
        on = min(a1 - p - n, b1 - q - n)
        if on:
            other = np.flatnonzero(a[p + n : p + n + on] != b[q + n : q + n + on])
            on = int(other[0]) if len(other) else on
        p, q, n = p - back, q - back, n + back + on
        if n:
            matched += n
            if more(matched):
                return True
            for c0, c1, d0, d1 in ((a0, p, b0, q), (p + n, a1, q + n, b1)):
                if c0 < c1 and d0 < d1:
                    most = min(c1 - c0, d1 - d0)
                    room += most
                    heapq.heappush(ranges, (-most, c0, c1, d0, d1, i, j, size))
        if not more(matched + room):
            return False
    return more(matched)
