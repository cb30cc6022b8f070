"""Skip-and-fold: one lookup table from code points to comparison codes, applied to whole Arrow batches.

Folding ignores blanks, punctuation, invisible characters and letter case, and
character forms. The few texts with letters of several scripts are first spelled consistently, as
whether a letter passes for another depends on its word. Canonical strings are never built: a batch
of texts becomes one flat array of codes plus row offsets.
"""

from __future__ import annotations

import hashlib
import unicodedata as ud

import numpy as np

from .scripts import invisible, spelled

# ASCII symbols that make another word, as letters do; others are quote marks, markup and ornament.
COUNTING = frozenset("$+=")


def fold_char(c: str) -> str:
    """What one character of a text in its consistent spelling counts as: nothing, or one or more comparison characters."""
    if invisible(c) or ud.category(c) == "Cc":
        return ""
    out = []
    for d in ud.normalize("NFKD", c):
        for e in ud.normalize("NFKD", d.casefold()):
            kind = ud.category(e)
            if kind[0] in "LN" or kind in ("Mn", "Mc") and not invisible(e) or kind[0] == "S" and (e > "\x7f" or e in COUNTING):
                out.append(e)
    return "".join(out)


def folded(text: str | None) -> str:
    """The canonical string itself, by definition; operators don't build it."""
    return "".join(map(fold_char, spelled(text or "")))


class Folder:
    """The lookup table, filled as code points first occur; one per Python worker."""

    def __init__(self) -> None:
        self.size = np.full(0x110000, 255, np.uint8)
        self.at = np.zeros(0x110000, np.int32)
        self.codes = np.zeros(1024, np.int32)
        self.used = 0

    def learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            codes = [] if 0xD800 <= p < 0xE000 else [ord(x) for x in fold_char(chr(p))]
            while self.used + len(codes) > len(self.codes):
                self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
            self.codes[self.used : self.used + len(codes)] = codes
            self.size[p], self.at[p] = len(codes), self.used
            self.used += len(codes)

    def fold(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts in a row, the offsets of each text in them, and for each code its character's place in the batch as spelled."""
        texts = [spelled(t) if t else t for t in texts]
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.int32)
        new = np.unique(points[self.size[points] == 255])
        if len(new):
            self.learn(new)
        n = self.size[points].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        origin = np.repeat(np.arange(len(points)), n)
        codes = self.codes[np.repeat(self.at[points] - (ends - n), n) + np.arange(total)]
        starts = np.concatenate([[0], np.cumsum(lens)])
        offsets = np.concatenate([[0], ends])[starts]
        return codes, offsets, origin


_folder: Folder | None = None


def folder() -> Folder:
    global _folder
    if _folder is None:
        _folder = Folder()
    return _folder


BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
INVERSE = np.uint64(pow(int(BASES[0]), -1, 1 << 64))


def powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = cache[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 4096), base, np.uint64))])
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poly_hashes(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit polynomial hashes of each text's codes: sum of code * base**place, with overflow."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], size)
    out = np.zeros((2, n), np.uint64)
    with np.errstate(over="ignore"):
        value = scramble(codes.astype(np.uint64) + np.uint64(1))
        for k, base in enumerate(BASES):
            terms = value * powers(base, int(size.max()) if n else 0)[place]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
            out[k] = scramble(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64))
    return out


def two_pointer_equal(a: str | None, b: str | None, step: int = 4096) -> bool:
    """Whether two texts have the same codes, read in step with two pointers, each skipping on its own."""
    a, b, i, j = spelled(a or ""), spelled(b or ""), 0, 0
    f, x, y = folder(), np.zeros(0, np.int32), np.zeros(0, np.int32)
    while True:
        while not len(x) and i < len(a):
            x, i = f.fold([a[i : i + step]])[0], i + step
        while not len(y) and j < len(b):
            y, j = f.fold([b[j : j + step]])[0], j + step
        n = min(len(x), len(y))
        if not n:
            return len(x) == len(y)
        if not np.array_equal(x[:n], y[:n]):
            return False
        x, y = x[n:], y[n:]


def code_digest(text: str | None, step: int = 4096) -> str:
    """SHA-256 of a text's codes, read piece by piece."""
    text, h = spelled(text or ""), hashlib.sha256()
    for i in range(0, len(text), step):
        h.update(folder().fold([text[i : i + step]])[0].tobytes())
    return h.hexdigest()


def blocks(texts: list, most: int = 400_000):
    """Row ranges whose texts have about ``most`` characters together, so that arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
