"""Evaluation texts inside training documents.

The items, a stated query set, are indexed by character q-grams. Each document is read against the index: shared
q-grams are counted in overlapping bands of diagonals, bands that meet the bound of the edit budget are kept, and
banded alignment verifies them; a passage without edits is the case of distance 0. Items of bounded size are
broadcast; beyond, their grams are joined with those of the documents, so that documents are read no more often.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .fold import BASES, INVERSE, blocks, folder, powers, scramble
from .scripts import spelled
from .sieve import passes, sieve_of

Q = 12  # codes in a gram at most; a Hangul syllable has two or three
BLOCK_CODES = 4_000_000  # codes of items that are indexed and broadcast at once
SEGMENT = 1_000_000  # characters of a document read at once; the codes of the longest item before them are read again
SLICE = 2_000_000  # hits held at once
WORDS = {"ko": 8, "en": 12}  # consecutive words that make a leak
FILTER_BITS = 22
BASE = BASES[0]


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each run of ``q`` codes, equal wherever the run stands: differences of the rolling polynomial, shifted back."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = scramble(codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes))[: len(codes)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        return scramble((sums[q:] - sums[:-q]) * powers(INVERSE, len(codes))[: len(codes) - q + 1] + np.uint64(q))


class Item:
    """An item's codes, where its words start and end in them, and what a leak of it has at least."""

    def __init__(self, item: object, text: str | None, lang: str | None, edits: int) -> None:
        self.id = item
        parts = [folder().fold([w])[0] for w in spelled(text or "").split()]
        parts = [p for p in parts if len(p)]
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        self.starts = self.ends - np.array([len(p) for p in parts], np.int64)
        share = np.mean((self.codes >= 0x1100) & (self.codes < 0x1200)) if len(self.codes) else 0
        self.least = WORDS.get((lang or "").lower(), WORDS["ko" if share > 0.3 else "en"])
        self.leaks = len(parts) >= self.least
        if not self.leaks:
            return
        begins, finishes = self.starts[: len(parts) - self.least + 1], self.ends[self.least - 1 :]
        self.shortest = int((finishes - begins).min())
        # The shortest passage gives the gram's length, so that every passage has a gram that no edit touches.
        self.q = max(1, min(Q, self.shortest // (edits + 1)))
        self.bound = max(1, self.shortest - self.q + 1 - self.q * edits)
        # Passages that repeat within the item are indexed once: repetitive items give no more hits than others.
        once = list({self.codes[a:b].tobytes(): (a, b) for a, b in zip(begins[::-1].tolist(), finishes[::-1].tolist(), strict=True)}.values())
        steps = np.zeros(len(self.codes) + 1, np.int64)
        for a, b in once:
            steps[a] += 1
            steps[b - self.q + 1] -= 1
        self.places = np.flatnonzero(np.cumsum(steps[:-1]) > 0)

    def grams(self) -> np.ndarray:
        return gram_hashes(self.codes, self.q)[self.places]


class Index:
    """The grams of some items, by length."""

    def __init__(self, rows: list[tuple], edits: int) -> None:
        self.edits = edits
        self.items = [i for i in (Item(*r, edits) for r in rows) if i.leaks]
        self.longest = max((len(i.codes) for i in self.items), default=0)
        self.bound = np.array([i.bound for i in self.items], np.int64)
        self.grams = {}
        for q in sorted({i.q for i in self.items}):
            at = [k for k, i in enumerate(self.items) if i.q == q]
            flat = np.concatenate([self.items[k].grams() for k in at])
            order = np.argsort(flat, kind="stable")
            item = np.repeat(at, [len(self.items[k].places) for k in at])[order]
            place = np.concatenate([self.items[k].places for k in at])[order]
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[flat >> np.uint64(64 - FILTER_BITS)] = True
            self.grams[q] = (flat[order], item, place, sieve)

    def overlap(self) -> int:
        """Codes of a stretch that the next one reads again: blanks and marks, however many, take nothing from the longest item."""
        return self.longest + 2 * self.edits + Q + 1


def _bands(diagonal: np.ndarray, edits: int) -> list[np.ndarray]:
    """Bands of each diagonal, numbered: of twice the budget's width, each overlapping half of the next, so that any edits + 1 neighbours are in one."""
    if not edits:
        return [2 * diagonal]
    return [2 * ((diagonal + shift) // (2 * edits)) + (shift > 0) for shift in (0, edits)]


def _diagonals(band: int, edits: int) -> range:
    first = (band // 2) * max(2 * edits, 1) - (edits if band % 2 else 0)
    return range(first, first + max(2 * edits, 1))


def scan(index: Index, codes: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, words, edits: items of which a text holds a passage, the most words found in a row, and the fewest edits of a passage.

    ``codes`` are those of all texts, parted by ``offsets``; ``starts``, ``ends``: whether a word starts, ends at each.
    """
    edits, n = index.edits, len(index.items)
    size = np.diff(offsets)
    spread = int(size.max(initial=0)) + 2 * index.longest + 4 * edits + 4
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q, (known, items, places, sieve) in index.grams.items():
        h = gram_hashes(codes, q)
        text = np.repeat(np.arange(len(size)), size)[: len(h)]
        at = np.flatnonzero(sieve[h >> np.uint64(64 - FILTER_BITS)])
        at = at[at + q <= offsets[text[at] + 1]]
        lo, hi = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], side="right")
        at, lo, hits = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.cumsum(hits)
        for a, b in zip(*_slices(upto), strict=True):
            m = hits[a:b]
            took = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            where = np.repeat(at[a:b], m)
            t, i = text[where], items[took]
            diagonal = where - offsets[t] - places[took] + index.longest + 2 * edits
            for band in _bands(diagonal, edits):
                found.append(np.unique((t * n + i) * (2 * spread) + band, return_counts=True))
    if not found:
        return
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    count = np.bincount(back, np.concatenate([c for _, c in found]))
    keys = keys[count >= index.bound[keys // (2 * spread) % n]]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for key in keys.tolist():
        pair, band = divmod(key, 2 * spread)
        t, i = divmod(pair, n)
        a, z = offsets[t], offsets[t + 1]
        diagonals = [d - index.longest - 2 * edits for d in _diagonals(band, edits)]
        w, e = _verify(index.items[i], codes[a:z], starts[a:z], ends[a:z], diagonals, edits)
        if e <= edits:
            had = best.get((t, i), (0, edits))
            best[t, i] = max(w, had[0]), min(e, had[1])
    yield from ((t, i, w, e) for (t, i), (w, e) in best.items())


def _slices(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of positions with at most about SLICE hits together."""
    if not len(upto):
        return np.zeros(0, int), np.zeros(0, int)
    edge = np.unique(np.searchsorted(upto, np.arange(SLICE, int(upto[-1]), SLICE))) + 1
    edge = edge[edge < len(upto)]
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(upto)]])


def _verify(it: Item, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, diagonals: list[int], edits: int) -> tuple[int, int]:
    """Along a band of diagonals: the longest run of the item's words, and the fewest edits of a passage (above the budget if none)."""
    best = 0
    for d in diagonals:
        lo, hi = max(0, -d), min(len(it.codes), len(codes) - d)
        if hi - lo < it.shortest:
            continue
        same = np.concatenate([[False], it.codes[lo:hi] == codes[lo + d : hi + d], [False]])
        turns = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(turns[::2] + lo, turns[1::2] + lo, strict=True):
            if b - a < it.shortest:
                continue
            w = np.arange(np.searchsorted(it.starts, a), np.searchsorted(it.ends, b, side="right"))
            begin = w[starts[it.starts[w] + d]]
            end = w[ends[it.ends[w] - 1 + d]]
            if len(begin) and len(end):
                best = max(best, int(end[-1] - begin[0]) + 1)
    if best >= it.least or not edits:
        return best, 0 if best >= it.least else edits + 1
    return best, _nearest(it, codes, diagonals, edits)


def _nearest(it: Item, codes: np.ndarray, diagonals: list[int], edits: int) -> int:
    """The fewest edits, one at least, of a passage within the band, by banded alignment of those passages whose codes nearly all stand somewhere in it."""
    lo, hi = diagonals[0], diagonals[-1]
    at = np.arange(len(it.codes))
    met = np.zeros(len(it.codes), bool)
    for d in range(lo - edits, hi + edits + 1):
        inside = (at + d >= 0) & (at + d < len(codes))
        met[inside] |= it.codes[inside] == codes[at[inside] + d]
    missing = np.concatenate([[0], np.cumsum(~met)])
    a, b = it.starts[: len(it.starts) - it.least + 1], it.ends[it.least - 1 :]
    best = edits + 1
    for x, y in sorted({(int(x), int(y)) for x, y in zip(a, b, strict=True) if missing[y] - missing[x] <= edits}):
        best = min(best, banded_distance(it.codes[x:y], codes, x + lo, x + hi, best - 1))
        if best <= 1:
            break
    return max(best, 1)  # without the ends of words it isn't the passage itself


def banded_distance(needle: np.ndarray, hay: np.ndarray, first: int, last: int, most: int) -> int:
    """Edits between the needle and a stretch of the hay that starts between two places, within ``most`` diagonals of them; ``most`` + 1 if more."""
    beyond = most + 1
    places = range(first - most, last + most + 1)
    row = [0 if first <= p <= last and 0 <= p <= len(hay) else beyond for p in places]
    for i, c in enumerate(needle.tolist()):
        new = []
        for k, p in enumerate(places):
            j = p + i  # this cell ends before place j + 1 of the hay
            cost = row[k] + (not 0 <= j < len(hay) or c != hay[j])
            if k + 1 < len(row):
                cost = min(cost, row[k + 1] + 1)
            if k:
                cost = min(cost, new[-1] + 1)
            new.append(min(cost, beyond))
        if min(new) > most:
            return beyond
        row = new
    return min(row)


_indexes: dict[str, Index] = {}


def _index(name: str, rows: list[tuple], edits: int) -> Index:
    """The index of a block of items, built once in each Python worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(rows, edits)
    return _indexes[name]


def _stretches(text: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, and whether a word starts, ends at each, of SEGMENT characters at a time, always with the last ``overlap`` codes before them."""
    codes, starts, before = np.zeros(0, np.int32), np.zeros(0, bool), -2
    for at in range(0, len(text), SEGMENT):
        new, _, origin = folder().fold([text[at : at + SEGMENT]])
        starts = np.concatenate([starts[max(0, len(starts) - overlap) :], np.diff(origin + at, prepend=before) > 1])
        codes = np.concatenate([codes[max(0, len(codes) - overlap) :], new])
        before = at + int(origin[-1]) if len(origin) else before
        # A word that may go on beyond the last code is seen again with what follows.
        yield codes, starts, np.append(starts[1:], at + SEGMENT >= len(text) or before < at + SEGMENT - 1) if len(codes) else starts


def _parts(texts: list[str], overlap: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, codes, offsets, word starts and word ends of texts in blocks; long texts in stretches."""
    short = [r for r, t in enumerate(texts) if len(t) <= SEGMENT]
    for r, t in enumerate(texts):
        if len(t) > SEGMENT:
            for codes, begun, ended in _stretches(spelled(t), overlap):
                yield [r], codes, np.array([0, len(codes)]), begun, ended
    for i, j in blocks([texts[r] for r in short]):
        codes, offsets, origin = folder().fold([texts[r] for r in short[i:j]])
        if len(codes):
            apart = np.concatenate([[True], np.diff(origin) > 1, [True]])
            apart[offsets] = True
            yield short[i:j], codes, offsets, apart[:-1], apart[1:]


def leaked_items(documents: DataFrame, items: DataFrame, edits: int = 0, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", lang: str = "lang") -> DataFrame:
    """``<item>, <doc>, words, edits``: each document that holds a passage of an item, the most words of it in a row, and the fewest edits of a passage.

    A passage is 12 words of an English item, 8 of a Korean one; ``edits`` codes of it may be dropped, added or replaced
    (0: none). Rows with a null key or text are left out; items shorter than a passage can't leak. Repeated
    rows of a document count once. Other columns are ignored; empty tables give no rows.
    """
    asked = items.select(F.col(item).alias("_i"), F.col(item_text).alias("_t"), F.col(lang).alias("_l")).where("_i is not null and _t is not null")
    docs = documents.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).where("_d is not null and _t is not null")
    size = asked.agg(F.sum(F.length("_t"))).first()[0] or 0
    found = _against_all(docs, asked, edits) if 3 * size <= BLOCK_CODES else _by_join(docs, asked, edits)
    return found.groupBy(F.col("_i").alias(item), F.col("_d").alias(doc)).agg(F.max("words").alias("words"), F.min("edits").alias("edits"))


def _found_schema(asked: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("_i", asked.schema["_i"].dataType), T.StructField("_d", docs.schema["_d"].dataType), T.StructField("words", T.IntegerType()), T.StructField("edits", T.IntegerType())])


def _found_batch(schema: T.StructType, ids: list, docs: pa.Array, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    numbers = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(schema["_i"].dataType)), docs.take(numbers[0]), *numbers[1:]], names=schema.names)


def _against_all(docs: DataFrame, asked: DataFrame, edits: int) -> DataFrame:
    """All items, few enough to be broadcast, against each document, which is read once and not shuffled."""
    rows = [tuple(r) for r in asked.toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    schema = _found_schema(asked, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*shared.value, edits)
        for b in batches:
            ids, got = [], []
            for at, *text in _parts(b.column(1).to_pylist(), index.overlap()):
                for t, i, w, e in scan(index, *text):
                    ids.append(index.items[i].id)
                    got.append((at[t], w, e))
            yield _found_batch(schema, ids, b.column(0), got)

    return docs.mapInArrow(run, schema)


def _by_join(docs: DataFrame, asked: DataFrame, edits: int) -> DataFrame:
    """Items of any size: their grams are joined with those of the documents and counted in bands; documents with a band that meets the bound are then scanned for those items."""

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kept = [], []
            for r, (t, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                i = Item(None, t, lang, edits)
                if i.leaks:
                    at += [r] * len(i.places)
                    kept.append(i)
            flat = [np.concatenate(x) if kept else np.zeros(0, np.int64) for x in ([i.grams().view(np.int64) for i in kept], [i.places for i in kept], *([np.full(len(i.places), f(i)) for i in kept] for f in (lambda i: i.q, lambda i: i.bound, lambda i: len(i.codes))))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(x.astype(np.int64)) for x in flat)], names=["_i", "h", "own", "q", "bound", "codes"])

    named = T.StructType([T.StructField("_i", asked.schema["_i"].dataType), *(T.StructField(c, T.LongType()) for c in ("h", "own", "q", "bound", "codes"))])
    grams = cut(asked.mapInArrow(item_grams, named))
    about = grams.agg(F.count("*"), F.max("codes"), F.collect_set("q")).first()
    sieve, longest, lengths = sieve_of(grams, "h", about[0]), about[1] or 0, sorted(about[2])

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = 0
            for at, codes, offsets, _, _ in _parts(b.column(1).to_pylist(), longest + 2 * edits + Q + 1):
                part += 1  # stretches of one text are kept apart
                text = np.repeat(np.arange(len(at)), np.diff(offsets))
                for q in lengths:
                    h = gram_hashes(codes, q)
                    hit = np.flatnonzero(sieve.value.holds(h))
                    hit = hit[hit + q <= offsets[text[hit] + 1]]
                    rows = pa.array(np.array(at)[text[hit]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.full(len(hit), part)), pa.array(h[hit].view(np.int64)), pa.array(hit - offsets[text[hit]])], names=["_d", "part", "h", "place"])

    placed = docs.mapInArrow(doc_grams, T.StructType([docs.schema["_d"], *(T.StructField(c, T.LongType()) for c in ("part", "h", "place"))]))
    diagonal = F.col("place") - F.col("own") + longest + 2 * edits
    band = F.array(2 * diagonal) if not edits else F.array(*(2 * F.floor((diagonal + s) / (2 * edits)) + int(s > 0) for s in (0, edits)))
    bands = placed.join(grams, "h").select("_d", "part", "_i", "bound", F.explode(band).alias("band")).groupBy("_d", "part", "_i", "bound", "band").count()
    pairs = cut(bands.where("count >= bound").select("_d", "_i").distinct())
    per = pairs.join(asked, "_i").groupBy("_d").agg(F.collect_list(F.struct("_i", F.col("_t").alias("item"), "_l")).alias("items"))
    some = docs.where(passes(sieve_of(pairs.select(F.xxhash64("_d").alias("h")), "h", pairs.count()), F.xxhash64("_d")))
    schema = _found_schema(asked, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = [], []
            for r, (t, rows) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                index = Index([tuple(x.values()) for x in rows], edits)
                for _, *text in _parts([t], index.overlap()):
                    for _, i, w, e in scan(index, *text):
                        ids.append(index.items[i].id)
                        got.append((r, w, e))
            yield _found_batch(schema, ids, b.column(0), got)

    return some.join(per, "_d").select("_d", "_t", "items").mapInArrow(run, schema)


def leak_report(leaks_found: DataFrame, items: DataFrame, item: str = "item_id", suite: str = "suite") -> DataFrame:
    """Per suite: items; those found word for word and their number of documents; those found with edits only, and likewise."""
    exact = F.col("edits") == 0
    found = leaks_found.groupBy(item).agg(F.count_if(exact).alias("_n"), F.count_if(~exact).alias("_m"))
    per = items.select(item, suite).distinct().join(found, item, "left").groupBy(suite)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("_n") > 0).alias("leaked_items"), total("_n").alias("leaks"), F.count_if((F.col("_n") == 0) & (F.col("_m") > 0)).alias("near_items"), total("_m").alias("near_leaks"))
