"""Reading level of each document.

Gradient-boosted regression trees over distributions of length, vocabulary, syntax
and cohesion, one model for each language, trained on the median rating of a bounded
sample of rated documents. Vocabulary, syntax (which word endings stand side by side) and
sentence openings are weighed by tables learned from the ratings, not by word lists.
Predictions are cross-validated with whole sources held out, and an isotonic curve over
the held-out predictions calibrates the grades.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import tokens
from .fold import scramble

MOST_LABELLED = 20_000  # rated documents a language's model is trained on; beyond it a sample by hash of the id
MOST_BROADCAST = 1_000_000  # ratings of 16 bytes each
LEXICON_BITS = 16  # each learned table has 2**16 cells
FOLDS = 5
ROUNDS, DEPTH, RATE, LEAF, SHRINK = 120, 4, 0.08, 12, 4.0
BINS = 48
CHUNK = 500  # documents described at once
SENTENCE = re.compile(r"[.!?。！？]+[\s\"'”’)\]」]*|\n+")
WORD = re.compile(r"([^\W_]+(?:['’][^\W_]+)?)|[,;:，；：、()\[\]–—]")  # a word, or nothing for a mark that parts clauses
QUANTILES = np.array((0.1, 0.25, 0.5, 0.75, 0.9))
SPREAD = 2 + len(QUANTILES)
KINDS = ("vocabulary", "syntax", "openings")  # what the learned tables of difficulty are about: stems, neighbouring word endings, first words
KNOWN = 300_000  # words whose cells a worker keeps


def spreads(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean, deviation and quantiles of each row's values, which stand in a row one after another; zeros for none."""
    out = np.zeros((len(sizes), SPREAD))
    if not len(values):
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = np.maximum(sizes, 1)
    mean = np.bincount(row, values, len(sizes)) / n
    out[:, 0] = mean
    out[:, 1] = np.sqrt(np.maximum(np.bincount(row, (values - mean[row]) ** 2, len(sizes)) / n, 0))
    rising = values[np.lexsort((values, row))]
    start = np.cumsum(sizes) - sizes
    at = QUANTILES * (n - 1)[:, None]
    lo = np.minimum(start[:, None] + np.floor(at).astype(np.int64), len(values) - 1)
    hi = np.minimum(start[:, None] + np.ceil(at).astype(np.int64), len(values) - 1)
    out[:, 2:] = rising[lo] * (1 - at + np.floor(at)) + rising[hi] * (at - np.floor(at))
    out[sizes == 0] = 0
    return out


_words: dict[str, dict[str, tuple[int, int]]] = {"ko": {}, "en": {}}


def _cells_of(words: list[str], language: str) -> tuple[list[int], list[int]]:
    """The cell of each word's stem, and a number for its ending: Korean stems and endings are two syllables long, English ones seven and three letters."""
    known = _words[language]
    if len(known) > KNOWN:
        known.clear()
    stem, ending = (2, 2) if language == "ko" else (7, 3)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh32_intdigest(w[:stem]) >> (32 - LEXICON_BITS), xxhash.xxh32_intdigest(w[-ending:])
    both = [known[w] for w in words]
    return [x for x, _ in both], [y for _, y in both]


class Described:
    """Features of documents of one language, with the cells of their words in the learned tables."""

    def __init__(self, texts: list[str], language: str) -> None:
        spread: list[list[list[float]]] = [[], [], [], [], [], []]
        plain, self.cells = [], {k: [] for k in KINDS}
        for t in texts:
            pieces = [WORD.findall(s) for s in SENTENCE.split(t.lower()) if s]
            sentences = [w for w in (list(filter(None, s)) for s in pieces) if w]
            words = list(chain.from_iterable(sentences))
            clauses = [len(list(g)) for s in pieces for word, g in groupby(s, bool) if word]
            sets = [set(s) for s in sentences]
            shared = [len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:], strict=False)]
            last: dict[str, int] = {}
            fresh, gaps = [], []
            for k, s in enumerate(sets):
                again = [k - last[w] for w in s if w in last]
                gaps += again
                fresh.append(1 - len(again) / len(s))
                last |= dict.fromkeys(s, k)
            lengths = list(map(len, words))
            for x, y in zip(spread, (list(map(len, sentences)), lengths, clauses, shared, fresh, gaps), strict=True):
                x.append(y)
            n, m = max(1, len(words)), max(1, len(sentences))
            plain.append((np.log1p(len(words)), np.log1p(len(sentences)), len(last) / n, len(last) / np.sqrt(n), len(gaps) / n, len(clauses) / m, sum(map(str.isdigit, words)) / n, t.count("\n") / m))
            stems, endings = _cells_of(words, language)
            e = np.array(endings, np.uint64)
            self.cells["vocabulary"].append(np.array(stems, np.int64))
            self.cells["syntax"].append((scramble((e[:-1] << np.uint64(32)) + e[1:]) >> np.uint64(64 - LEXICON_BITS)).astype(np.int64))
            self.cells["openings"].append(np.array([xxhash.xxh32_intdigest(s[0]) >> (32 - LEXICON_BITS) for s in sentences], np.int64))
        flat = [(np.array([v for row in x for v in row], float), np.array(list(map(len, x)), np.int64)) for x in spread]
        self.rows = np.hstack([*(spreads(v, n) for v, n in flat), np.array(plain, float).reshape(len(texts), -1)])

    def __len__(self) -> int:
        return len(self.rows)

    def some(self, at: np.ndarray) -> Described:
        """The documents at these places (numbers or a mask)."""
        out = object.__new__(Described)
        places = np.arange(len(self))[at]
        out.rows, out.cells = self.rows[places], {k: [c[i] for i in places] for k, c in self.cells.items()}
        if hasattr(self, "once"):
            out.once = {k: [c[i] for i in places] for k, c in self.once.items()}
        return out

    def with_distinct(self) -> Described:
        """Itself, with the distinct cells of each document, which training asks for many times."""
        self.once = {k: [np.unique(c) for c in cells] for k, cells in self.cells.items()}
        return self

    def with_tables(self, tables: dict[str, np.ndarray]) -> np.ndarray:
        """The features, and for each table the spread of difficulty over the document's cells."""
        learned = [spreads(tables[k][np.concatenate(c)] if c else np.zeros(0), np.array(list(map(len, c)), np.int64)) for k, c in self.cells.items()]
        return np.hstack([self.rows, *learned])


def learned_tables(docs: Described, y: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind, how far above the mean the ratings of documents with a cell are, drawn towards 0 where few are known."""
    out = {}
    for k, cells in docs.once.items():
        flat = np.concatenate(cells)
        total = np.bincount(flat, np.repeat(y - y.mean(), list(map(len, cells))), 1 << LEXICON_BITS)
        out[k] = total / (np.bincount(flat, minlength=1 << LEXICON_BITS) + 5.0)
    return out


class Boosted:
    """Least-squares boosting of depth-limited trees over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        n, f = b.shape
        self.base = float(y.mean()) if n else 3.5
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        guess = np.full(n, self.base)
        cells = b + np.arange(f) * BINS
        for _ in range(ROUNDS if n >= 2 * LEAF else 0):
            residual = y - guess
            node = np.zeros(n, int)
            feature, at = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, int)
            for level in range(DEPTH):
                nodes = 2**level
                # Rows of right children only are counted; the left ones are what is left of their parents.
                rows = np.flatnonzero(node & 1) if level else np.arange(n)
                flat = (((node[rows] >> 1) * f * BINS)[:, None] + cells[rows]).ravel()
                size = max(nodes // 2, 1) * f * BINS
                own = [np.bincount(flat, w, size).reshape(-1, f, BINS) for w in (None, np.repeat(residual[rows], f))]
                parts = [np.stack([p - o, o], 1).reshape(nodes, f, BINS) for p, o in zip(parts, own, strict=True)] if level else own
                count, total = (p.cumsum(2) for p in parts)
                cl, tl = count[:, :, :-1], total[:, :, :-1]
                cr, tr = count[:, :, -1:] - cl, total[:, :, -1:] - tl
                gain = tl**2 / (cl + SHRINK) + tr**2 / (cr + SHRINK) - total[:, :, -1:] ** 2 / (count[:, :, -1:] + SHRINK)
                gain[(cl < LEAF) | (cr < LEAF)] = 0
                gain = gain.reshape(nodes, -1)
                best = gain.argmax(1)
                splits = gain[np.arange(nodes), best] > 1e-9
                k = nodes - 1 + np.arange(nodes)
                feature[k[splits]], at[k[splits]] = best[splits] // (BINS - 1), best[splits] % (BINS - 1)
                own = feature[nodes - 1 + node]
                node = 2 * node + ((own >= 0) & (b[np.arange(n), np.maximum(own, 0)] > at[nodes - 1 + node]))
            leaf = RATE * np.bincount(node, residual, 2**DEPTH) / (np.bincount(node, minlength=2**DEPTH) + SHRINK)
            guess += leaf[node]
            self.trees.append((feature, at, leaf))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, at, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(DEPTH):
                k = 2**level - 1 + node
                node = 2 * node + ((feature[k] >= 0) & (b[rows, np.maximum(feature[k], 0)] > at[k]))
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve through (x, y) of least squares, as its corners: pool adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean of y, weight, mean of x
    for i in order:
        pools.append([float(y[i]), 1.0, float(x[i])])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


class Model:
    """Learned tables, trees and calibration of one language."""

    def fit(self, docs: Described, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Trains; returns the grades of the training documents as models without their sources, calibrated without their sources, give them."""
        held = np.full(len(y), float(y.mean()) if len(y) else 3.5)
        for k in range(FOLDS):
            out = fold == k
            if out.any() and not out.all():
                held[out] = self._raw(self._one(docs.some(~out), y[~out]), docs.some(out))
        self.curve = isotonic(held, y) if len(y) else (np.array([1.0, 6.0]), np.array([1.0, 6.0]))
        self.parts = self._one(docs, y)
        graded = held.copy()
        for k in range(FOLDS):
            out = fold == k
            if out.any() and not out.all():
                graded[out] = np.interp(held[out], *isotonic(held[~out], y[~out]))
        return graded

    def _one(self, docs: Described, y: np.ndarray) -> tuple[dict[str, np.ndarray], Boosted]:
        # Trees must not learn from a word's rating through the document itself: half the documents give the tables of the other half.
        half = np.arange(len(y)) % 2 == 0
        full = learned_tables(docs, y)
        x = np.empty((len(y), docs.rows.shape[1] + SPREAD * len(KINDS)))
        for part in (half, ~half):
            if part.any():
                x[part] = docs.some(part).with_tables(full if part.all() else learned_tables(docs.some(~part), y[~part]))
        return full, Boosted().fit(x, y)

    @staticmethod
    def _raw(parts: tuple[dict[str, np.ndarray], Boosted], docs: Described) -> np.ndarray:
        return parts[1].predict(docs.with_tables(parts[0]))

    def predict(self, docs: Described) -> np.ndarray:
        return np.interp(self._raw(self.parts, docs), *self.curve)


def median_ratings(labels: DataFrame, doc: str = "doc_id", rater: str = "rater", level: str = "reading_level") -> DataFrame:
    """``<doc>, rating``: the median over raters; repeated rows count once, null levels not at all."""
    return labels.where(F.col(level).isNotNull() & F.col(doc).isNotNull()).select(doc, rater, level).distinct().groupBy(doc).agg(F.median(level).alias("rating"))


def _main_language(text: str) -> Column:
    """ko or en, whichever has more of the letters; null without letters of either."""
    text = F.coalesce(F.col(text), F.lit(""))
    h, latin = 2 * F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(h + latin == 0, F.lit(None)).when(h >= latin, "ko").otherwise("en")


def train(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row with ``language, model`` for each language, and one with ``language, doc_id, source, rating, held_out`` for each training document."""
    ratings = cut(median_ratings(labels))
    # Few ratings go to the documents, so that only rated texts move; beyond the bound both sides are shuffled.
    ratings = F.broadcast(ratings) if ratings.count() <= MOST_BROADCAST else ratings
    rated = documents.where("text is not null").join(ratings, "doc_id").dropDuplicates(["doc_id"])
    rated = cut(rated.select("doc_id", tokens.source_key("source").alias("source"), "text", "rating", _main_language("text").alias("language")).where("language is not null"))
    # A bounded sample for each language: the smallest hashes of the ids, without gathering a language's rows anywhere first.
    counts = rated.groupBy("language").agg(F.count("*").alias("_n"))
    share = F.lit(float(MOST_LABELLED)) / F.col("_n")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bounded = rated.join(F.broadcast(counts), "language").where(unit < share).drop("_n")  # two rows

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        language = rows["language"].iloc[0]
        docs = Described(rows["text"].tolist(), language).with_distinct()
        fold = np.array([xxhash.xxh32_intdigest(s or "") % FOLDS for s in rows["source"]])
        model = Model()
        held = model.fit(docs, rows["rating"].to_numpy(float), fold)
        out = rows[["language", "doc_id", "source", "rating"]].assign(held_out=held, model=None)
        one = pd.DataFrame([{"language": language, "doc_id": None, "source": None, "rating": None, "held_out": None, "model": pickle.dumps(model)}])
        columns = {c: [*out[c].tolist(), *one[c].tolist()] for c in out.columns}
        return pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "doc_id" else pd.Series(v, dtype=object) for c, v in columns.items()})

    return cut(bounded.groupBy("language").applyInPandas(run, "language string, doc_id long, source string, rating double, held_out double, model binary"))


def reading_levels(documents: DataFrame, trained: DataFrame) -> DataFrame:
    """``doc_id, language, score, reading_level`` of every document, once each.

    ``score`` is the calibrated grade, ``reading_level`` the nearest whole one from 1 to
    6. Both are null for a text without Korean or English letters, or null, and for a
    language that nobody rated.
    """
    models = {r.language: r.model for r in trained.where("model is not null").select("language", "model").collect()}  # one row a language
    shared = documents.sparkSession.sparkContext.broadcast(models)
    rows = documents.where("doc_id is not null").select("doc_id", _main_language("text").alias("language"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reading_level", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: pickle.loads(m) for k, m in shared.value.items()}
        for b in batches:
            language, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            score = np.full(len(texts), np.nan)
            for name, model in ready.items():
                at = [i for i, x in enumerate(language) if x == name]
                for k in range(0, len(at), CHUNK):
                    some = at[k : k + CHUNK]
                    score[some] = model.predict(Described([texts[i] for i in some], name))
            known = ~np.isnan(score)
            level = np.clip(np.floor(np.where(known, score, 1) + 0.5), 1, 6).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, mask=~known), pa.array(level, mask=~known)], names=schema.names)

    # Repeated ids are merged once their texts are mere numbers: no text is shuffled.
    best = F.max(F.struct("score", "reading_level", "language")).alias("m")
    return rows.mapInArrow(run, schema).groupBy("doc_id").agg(best).select("doc_id", "m.language", "m.score", "m.reading_level")


def level_profile(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """Per source and domain: documents, mean score, and how many are of each level. Spellings of a source are one; nulls are groups."""
    rows = documents.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", tokens.source_key("source").alias("source_key"), "domain").join(levels, "doc_id")
    each = (F.count_if(F.col("reading_level") == k).alias(f"level_{k}") for k in range(1, 7))
    return rows.groupBy("source_key", "domain").agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"), *each)


def held_out_report(trained: DataFrame) -> DataFrame:
    """Per language and source: rated documents, mean absolute error of the held-out grades, and the share within one grade."""
    off = F.abs(F.col("held_out") - F.col("rating"))
    return trained.where("model is null").groupBy("language", "source").agg(F.count("*").alias("rated"), F.avg(off).alias("mean_error"), F.avg((off <= 1).cast("int")).alias("within_one"))
