"""Canonical words: the fold table as a character translation that keeps blanks."""

from __future__ import annotations

import unicodedata as ud

from .fold import fold_char
from .scripts import spelled


class _Words(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = value = " " if c.isspace() or ud.category(c) == "Zs" or c == "ㅤ" else fold_char(c)
        return value


_table = _Words()


def words(text: str | None) -> list[str]:
    """The folded words of a text; tokens of punctuation alone are none."""
    return ud.normalize("NFC", spelled(text).translate(_table)).split() if text else []


def is_hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def hangul(ws: list[str]) -> int:
    return sum(is_hangul(c) for w in ws for c in w)


def edits(a: list[str], b: list[str], most: int) -> int:
    """Words dropped, added or replaced between two word lists, at most ``most`` + 1; words joined or parted, however many, cost nothing.

    The texts are aligned without blanks. An edit takes a stretch of at most one word of each
    text away; it starts and ends where a word of either text does, so a word changed inside
    joined words costs one.
    """
    if a == b or "".join(a) == "".join(b):
        return 0
    # Growing limits: long texts with few changes take time in proportion to length and changes.
    limit = min(4, most)
    while True:
        got = _aligned(a, b, limit)
        if got <= limit or limit == most:
            return min(got, most + 1)
        limit = min(2 * limit, most)


def _ends(ws: list[str]) -> list[int]:
    """For each place in the text without blanks, where the word that it is in ends."""
    out: list[int] = []
    for w in ws:
        out += [len(out) + len(w)] * len(w)
    return out


def _aligned(a: list[str], b: list[str], most: int) -> int:
    """Edits, ``most`` + 1 if they are more: all places reached with no edit, then with one, and so on."""
    x, y, ex, ey = "".join(a), "".join(b), _ends(a), _ends(b)
    n, m = len(x), len(y)
    wide_x, wide_y = max(map(len, a), default=0), max(map(len, b), default=0)
    seen: set[tuple[int, int]] = set()
    todo = [(0, 0)]
    for cost in range(most + 1):
        here = []
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            i, j = at
            if i == n and j == m:
                return cost
            longer = (n - i) - (m - j)  # an edit evens out one word at most
            if longer > (most - cost) * wide_x or -longer > (most - cost) * wide_y:
                continue
            here.append(at)
            if i < n and j < m:
                t = min(ex[i] - i, ey[j] - j)
                if x[i : i + t] == y[j : j + t]:
                    todo.append((i + t, j + t))
        if cost < most:
            for i, j in here:
                if i < n:
                    todo.append((ex[i], j))
                if j < m:
                    todo.append((i, ey[j]))
                if i < n and j < m:
                    todo.append((ex[i], ey[j]))
                    todo += [(ex[i], k) for k in _resumed(y, j, ey[j], x, ex[i], ex)]
                    todo += [(k, ey[j]) for k in _resumed(x, i, ex[i], y, ey[j], ey)]
    return most + 1


def _resumed(text: str, start: int, end: int, other: str, at: int, ends: list[int]) -> list[int]:
    """Places inside a word of ``text`` from which it goes on like ``other`` does at ``at``, to the end of either word."""
    if at == len(other):
        return []
    word, first = other[at : ends[at]], other[at]
    out = []
    k = text.find(first, start + 1, end)
    while k >= 0:
        t = min(len(word), end - k)
        if text[k : k + t] == word[:t]:
            out.append(k)
        k = text.find(first, k + 1, end)
    return out


def far_apart(a: list[str], b: list[str], most: int) -> bool:
    """A quick proof that more than ``most`` words differ: a word that the other text doesn't hold, blanks aside, has a changed word in it.

    A changed word may have been parted in two, so each change accounts for two such words.
    """
    x, y, p, q = "".join(a), "".join(b), set(a), set(b)
    return sum(w not in q and w not in y for w in a) > 2 * most or sum(w not in p and w not in x for w in b) > 2 * most


def near(a: list[str], b: list[str], share: int = 6) -> bool:
    """Whether at most one word in ``share`` differs."""
    return edits(a, b, max(len(a), len(b)) // share) <= max(len(a), len(b)) // share
