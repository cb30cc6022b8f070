"""Same or near-same records across splits.

Exact overlap: hashes of canonical records, evaluation joined with training.

Near overlap, without loss. Two texts are near if at most K stretches, none above a word, are
changed in the texts without blanks; K is a ``share``-th of the words of the text that has more
words. So they agree in K + 1 fragments, of which the longest is at least F long, and the text
with more words (the finer) knows K and F from itself. It is hashed at the greatest length of a
fixed ladder that F reaches: for K = 0 as a whole; for K = 1 its beginning and its end; beyond,
the winnowed grams, of which any fragment of that length holds one. The other text (the coarser,
in which any words may be joined) is hashed so at all lengths that some finer text of the other
split uses. Every record plays both parts, so near records always share a hash, whatever else is
in the corpus. A hash shared by many records of both splits counts only together with one of the
other side, which is also near and so is bound to share one too. If that is hot as well (records from
a template), beginning and end are hashed together: with one change, a beginning that ends between two
steps of the ladder leaves an end of known length. Candidates are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .fold import BASES, INVERSE, powers, scramble
from .sieve import Filling, merged, passes, sieve_of, size_for
from .words import far_apart, hangul, is_hangul, near, words

HOT = 32  # records of both splits under one hash, beyond which it counts only with one of the other side
WHOLE, FIRST, LAST, WITHIN, ENDS, ANY = range(6)  # kinds of hashes


def _ladder(most: int = 1 << 22) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array(out)


LADDER = _ladder()


def _canonical(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key, split, wa, wb``: canonical words, the side with more Hangul first."""
    schema = T.StructType([df.schema[key], T.StructField("_val", T.BooleanType()), T.StructField("wa", T.StringType()), T.StructField("wb", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wa, wb = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = words(x), words(y)
                if (hangul(x), x) < (hangul(y), y):
                    x, y = y, x
                wa.append(" ".join(x))
                wb.append(" ".join(y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wa, pa.string()), pa.array(wb, pa.string())], names=schema.names)

    return df.select(key, "_val", left, right).mapInArrow(run, schema)


class Texts:
    """Texts without blanks in a row, with the hash of any stretch."""

    def __init__(self, texts: list[str]) -> None:
        squeezed = [t.replace(" ", "") for t in texts]
        self.size = np.fromiter(map(len, squeezed), np.int64, len(squeezed))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        codes = np.frombuffer("".join(squeezed).encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            terms = scramble(codes.astype(np.uint64) + np.uint64(1)) * powers(BASES[0], len(codes))[: len(codes)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])

    def stretch(self, a: np.ndarray, b: np.ndarray, kind: int, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            got = (self.sums[b] - self.sums[a]) * powers(INVERSE, len(self.sums))[a]
            return scramble(scramble(got) + np.uint64(kind << 32 | length))

    def whole(self, rows: np.ndarray) -> np.ndarray:
        return self.stretch(self.start[rows], self.end[rows], WHOLE, 0)

    def first(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.stretch(self.start[rows], self.start[rows] + length, FIRST, length)

    def last(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.stretch(self.end[rows] - length, self.end[rows], LAST, length)

    def within(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of the winnowed grams: the least gram of each window, so that any stretch of ``length`` holds one.

        Two thirds of the length are the gram's, the rest is the window's.
        """
        q = (2 * length + 2) // 3
        w = length - q + 1
        total = len(self.sums) - 1
        if total < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        a = np.arange(total - q + 1)
        least, have = self.stretch(a, a + q, WITHIN, length), 1
        while 2 * have <= w:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if w > have:
            least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
        row = np.repeat(np.arange(len(self.size)), self.size)[: len(least)]
        inside = np.arange(len(least)) + length <= self.end[row]
        fresh = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(least) != 0)])  # a run of windows with one gram counts once
        at = np.flatnonzero(inside & (fresh | np.concatenate([[True], ~inside[:-1]])))
        return row[at], least[at]


Steps = set[tuple[int, int, int]]  # kinds of hashes with one or two steps of the ladder
Hashed = tuple[np.ndarray, np.ndarray]  # rows and hashes


def _known(texts: list[str], share: int) -> tuple[np.ndarray, np.ndarray]:
    """How many changes there may be if a text is the finer one, and how much at least is then common to both."""
    sizes = [sorted(map(len, t.split(" ")), reverse=True) if t else [] for t in texts]
    k = np.array([len(s) // share for s in sizes], np.int64)
    return k, np.array([sum(s) - sum(s[:n]) for s, n in zip(sizes, k.tolist(), strict=True)], np.int64)


def _fine(texts: list[str], share: int) -> tuple[Hashed, Steps]:
    """The hashes of the texts as the finer ones, and which steps they use: one fragment of the longest length that is certain."""
    k, common = _known(texts, share)
    step = np.searchsorted(LADDER, -(-common // (k + 1)), side="right") - 1
    t = Texts(texts)
    zero = np.flatnonzero(k == 0)
    rows, keys, used = [zero], [t.whole(zero)], set()
    for s in np.unique(step[k == 1]).tolist():
        at = np.flatnonzero((k == 1) & (step == s))
        rows += [at, at]
        keys += [t.first(at, int(LADDER[s])), t.last(at, int(LADDER[s]))]
        used.add((FIRST, s, 0))
    for s in np.unique(step[k > 1]).tolist():
        at = np.flatnonzero((k > 1) & (step == s))
        r, h = Texts([texts[i] for i in at]).within(int(LADDER[s]))
        rows.append(at[r])
        keys.append(h)
        used.add((WITHIN, s, 0))
    return (np.concatenate(rows), np.concatenate(keys)), used


def _coarse(texts: list[str], used: Steps) -> Hashed:
    """The hashes of the texts as the coarser ones, at the steps that finer ones use."""
    t = Texts(texts)
    every = np.arange(len(texts))
    rows, keys = [every], [t.whole(every)]
    for kind, s, _ in sorted(used):
        length = int(LADDER[s])
        if kind == FIRST:  # two fragments: the longer has at most all, and its bound is at most half of the text
            at = np.flatnonzero(t.size >= 2 * length - 1)
            rows += [at, at]
            keys += [t.first(at, length), t.last(at, length)]
        elif kind == WITHIN:  # three or more
            at = np.flatnonzero(t.size >= 3 * length - 2)
            if len(at):
                r, h = (t if len(at) == len(texts) else Texts([texts[i] for i in at])).within(length)
                rows.append(at[r])
                keys.append(h)
    return np.concatenate(rows), np.concatenate(keys)


def _both_ends(t: Texts, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hashes of a beginning and an end of the lengths of two steps, counted from 1; 0 is none."""
    begin, end = (t.first(at, int(LADDER[first - 1])) if first else np.zeros(len(at), np.uint64)), (t.last(at, int(LADDER[last - 1])) if last else np.zeros(len(at), np.uint64))
    with np.errstate(over="ignore"):
        return scramble(begin * np.uint64(0x9E3779B97F4A7C15) + end + np.uint64(ENDS << 48 | first << 24 | last))


def _fine_ends(texts: list[str], share: int) -> tuple[Hashed, Steps]:
    """As ``_fine``, with all that is certain of texts with one change. For each step that the common beginning may reach, it is hashed with
    the end that is then left. Of texts with more changes nothing more is said: they meet all."""
    k, common = _known(texts, share)
    t = Texts(texts)
    zero, more = np.flatnonzero(k == 0), np.flatnonzero(k > 1)
    rows, keys, used = [zero, more], [t.whole(zero), np.full(len(more), ANY, np.uint64)], {(ANY, 0, 0)} if len(more) else set()
    one = np.flatnonzero(k == 1)
    for first in range(int(np.searchsorted(LADDER, t.size[one].max(initial=0), side="right")) + 1):
        at = one[t.size[one] >= (LADDER[first - 1] if first else 0)]
        last = np.searchsorted(LADDER, np.maximum(common[at] - LADDER[first] + 1, 0), side="right")
        for n in np.unique(last).tolist():
            rows.append(at[last == n])
            keys.append(_both_ends(t, rows[-1], first, n))
            used.add((ENDS, first, n))
    return (np.concatenate(rows), np.concatenate(keys)), used


def _coarse_ends(texts: list[str], used: Steps) -> Hashed:
    t = Texts(texts)
    every = np.arange(len(texts))
    rows, keys = [every], [t.whole(every)]
    for kind, first, last in sorted(used):
        if kind == ANY:
            rows.append(every)
            keys.append(np.full(len(every), ANY, np.uint64))
        else:
            at = np.flatnonzero(t.size >= (LADDER[first - 1] if first else 0) + (LADDER[last - 1] if last else 0))
            rows.append(at)
            keys.append(_both_ends(t, at, first, last))
    return np.concatenate(rows), np.concatenate(keys)


def _settled(wa: str, wb: str, share: int) -> bool:
    """Whether each near copy of a record has Hangul in the copy of its first side, so that its sides can't be taken for one another.

    The second side has none; in the first more letters than those outside Hangul outlast any changes.
    """
    if any(map(is_hangul, wb)):
        return False
    other = sum(not is_hangul(c) for c in wa if c != " ")
    sizes = sorted(map(len, wa.split(" ")), reverse=True)
    changed = max(len(sizes), other) // (share - 1)
    return sum(sizes) - sum(sizes[:changed]) > other


def _slots(wa: list[str], wb: list[str], share: int) -> list[tuple[list[str], np.ndarray]]:
    """For the first and the second side: the texts that may stand there and their rows; unsettled records have both of theirs in both."""
    loose = np.array([i for i, (x, y) in enumerate(zip(wa, wb, strict=True)) if not _settled(x, y, share)], np.int64)
    every = np.arange(len(wa))
    return [(own + [other[i] for i in loose], np.concatenate([every, loose])) for own, other in ((wa, wb), (wb, wa))]


def _tagged(keys: np.ndarray, slot: int, finer: int) -> np.ndarray:
    """Hashes of one side, and of pairs whose finer text is of the training split (1) or not (0)."""
    with np.errstate(over="ignore"):
        return scramble(keys + np.uint64(4 * slot + finer + 1))


def _finer_sieve(reps: DataFrame, n: int, slot: int, fine: Callable, share: int) -> object:
    """Hashes of all finer texts of one side in a sieve, and the steps that occur."""
    bits = size_for(8 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, steps = Filling(bits), set()
        for b in batches:
            split = [b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (0, 1)]
            texts, own = _slots(b.column(2).to_pylist(), b.column(3).to_pylist(), share)[slot]
            (rows, keys), used = fine(texts, share)
            for finer in (0, 1):
                f.add(_tagged(keys[split[finer][own[rows]]], slot, finer))
            steps |= used
        yield f.batch()
        # Steps as words below 0, of which there are at most some hundred.
        yield pa.RecordBatch.from_arrays([pa.array([-1 - (kind << 16 | a << 8 | c) for kind, a, c in steps], pa.int32()), pa.array([1] * len(steps), pa.int64())], names=["word", "bits"])

    filled = cut(reps.select("v", "t", "wa", "wb").mapInArrow(run, "word int, bits long"))
    codes = [-1 - r.word for r in filled.where("word < 0").distinct().collect()]
    return reps.sparkSession.sparkContext.broadcast((merged(filled, bits), {(x >> 16, x >> 8 & 255, x & 255) for x in codes}))


def _hashes(reps: DataFrame, n: int, slot: int, share: int, ends: bool = False) -> DataFrame:
    """``sig, training, cls, hi, lo``: the texts with the hashes of one of their sides in both parts; coarse ones only if a finer text has them."""
    fine, coarse_of = (_fine_ends, _coarse_ends) if ends else (_fine, _coarse)
    sieve = _finer_sieve(reps, n, slot, fine, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, used = sieve.value
        for b in batches:
            split = [b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (3, 4)]
            texts, own = _slots(b.column(5).to_pylist(), b.column(6).to_pylist(), share)[slot]
            (rows, keys), _ = fine(texts, share)
            crows, ckeys = coarse_of(texts, used)
            for training in (0, 1):
                here = split[training][own[rows]]
                finer, frow = _tagged(keys[here], slot, training), own[rows[here]]
                here = split[training][own[crows]]
                coarse, crow = _tagged(ckeys[here], slot, 1 - training), own[crows[here]]
                hit = known.holds(coarse)
                row = np.concatenate([frow, crow[hit]])
                sig = np.concatenate([finer, coarse[hit]]).view(np.int64)
                once = np.unique(np.column_stack([row, sig]), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                at = pa.array(once[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 1]), pa.array(np.full(len(once), bool(training))), *(b.column(k).take(at) for k in range(3))], names=["sig", "training", "cls", "hi", "lo"])

    return reps.select("cls", "hi", "lo", "v", "t", "wa", "wb").mapInArrow(run, "sig long, training boolean, cls long, hi long, lo long")


def _meeting(hashes: DataFrame) -> DataFrame:
    """``hi1, lo1, hi2, lo2``: texts of validation and of training records that share a hash and aren't the same less blanks."""
    one = hashes.where("not training").select("sig", F.col("cls").alias("cls1"), F.col("hi").alias("hi1"), F.col("lo").alias("lo1"))
    two = hashes.where("training").select("sig", F.col("cls").alias("cls2"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    return one.join(two, "sig").where("cls1 <> cls2").select("hi1", "lo1", "hi2", "lo2")


def _candidates(reps: DataFrame, share: int) -> DataFrame:
    """``hi1, lo1, hi2, lo2``: all texts that may be near, once each."""
    hashes = cut(_hashes(reps, reps.count(), 0, share))
    met = []
    for slot, ends in ((1, False), (0, True), (1, True)):
        each = hashes.groupBy("sig").agg(F.count_if(~F.col("training")).alias("v"), F.count_if("training").alias("t"))
        hot = cut(each.where(F.least("v", "t") > HOT).select("sig"))
        met.append(_meeting(hashes.join(hot, "sig", "left_anti")))
        again = cut(hashes.join(hot, "sig"))
        n = again.count()
        if not n:
            return cut(reduce(DataFrame.unionByName, met).distinct())
        further = _hashes(reps.where(passes(sieve_of(again, "hi", n), "hi")), n, slot, share, ends).select(F.col("sig").alias("further"), "training", "hi", "lo")
        hashes = cut(again.join(further, ["hi", "lo", "training"]).select(F.xxhash64("sig", "further").alias("sig"), "training", "cls", "hi", "lo"))
    return cut(reduce(DataFrame.unionByName, [*met, _meeting(hashes)]).distinct())


def _near_records(share: int):  # noqa: ANN202
    @F.pandas_udf(T.BooleanType())
    def check(a1, b1, a2, b2):  # noqa: ANN001, ANN202
        import pandas as pd

        def same(*pairs: tuple[list[str], list[str]]) -> bool:
            return not any(far_apart(x, y, max(len(x), len(y)) // share) for x, y in pairs) and all(near(x, y, share) for x, y in pairs)

        rows = ([x.split() for x in row] for row in zip(a1, b1, a2, b2, strict=True))
        return pd.Series([same((p, r), (q, s)) or same((p, s), (q, r)) for p, q, r, s in rows], dtype=bool)

    return check


def cross_split_links(df: DataFrame, key: str = "pair_id", left: str = "ko_text_analysis", right: str = "en_text_analysis", validation: str = "is_validation_upstream", share: int = 6) -> tuple[DataFrame, DataFrame]:
    """The records, and the near texts among theirs.

    First ``_k, _val, key_hi, key_lo, hi, lo``: each record, its split, its class (same less blanks) and its text (same
    words; nearness depends on where words end). Then ``hi1, lo1, hi2, lo2``: each text of validation records with each of
    training records that is near to it, but not of its class.
    """
    df = df.select(F.col(key).alias("_k"), F.coalesce(F.col(validation), F.lit(False)).alias("_val"), F.col(left).alias("_a"), F.col(right).alias("_b")).where(F.col("_k").isNotNull())
    keyed = cut(_canonical(df, "_k", "_a", "_b").transform(record_keys_of))
    # One row for each text; texts of one record aren't moved twice.
    ends = F.struct("wa", "wb", F.col("key_hi").alias("cls"))
    reps = cut(
        keyed.groupBy("hi", "lo").agg(F.any_value(ends).alias("w"), F.bool_or("_val").alias("v"), F.bool_or(~F.col("_val")).alias("t")).select("hi", "lo", "w.cls", "w.wa", "w.wb", "v", "t"),
        rows_per_file=16_384,
    )
    candidates = _candidates(reps, share)
    # Only texts of candidates are moved.
    some = reps.where(passes(sieve_of(candidates.select(F.explode(F.array("hi1", "hi2")).alias("hi")), "hi", 2 * candidates.count()), "hi"))
    texts = lambda k: some.select(F.col("hi").alias(f"hi{k}"), F.col("lo").alias(f"lo{k}"), F.col("wa").alias(f"a{k}"), F.col("wb").alias(f"b{k}"))
    links = candidates.join(texts(1), ["hi1", "lo1"]).join(texts(2), ["hi2", "lo2"]).where(_near_records(share)("a1", "b1", "a2", "b2")).select("hi1", "lo1", "hi2", "lo2")
    return keyed.select("_k", "_val", "key_hi", "key_lo", "hi", "lo"), cut(links)


def cross_split_pairs(
    df: DataFrame, key: str = "pair_id", left: str = "ko_text_analysis", right: str = "en_text_analysis", validation: str = "is_validation_upstream", share: int = 6
) -> DataFrame:
    """``<key>_a, <key>_b`` (a < b), ``exact``: all pairs of one validation and one training record that are the same or near.

    ``share``: at most one word in so many may differ on each side. ``key`` must be
    unique; rows with a null key are left out. A null split is training. Null text
    counts as empty. Other columns are ignored. An empty table gives no pairs.
    """
    members, linked = cross_split_links(df, key, left, right, validation, share)
    val, train = (members.where(c).drop("_val") for c in ("_val", "not _val"))
    near_pairs = (
        val.select(F.col("_k").alias("_v"), F.col("hi").alias("hi1"), F.col("lo").alias("lo1"))
        .join(linked, ["hi1", "lo1"])
        .join(train.select(F.col("_k").alias("_t"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2")), ["hi2", "lo2"])
        .select("_v", "_t", F.lit(False).alias("exact"))
    )
    exact_pairs = val.select("key_hi", "key_lo", F.col("_k").alias("_v")).join(train.select("key_hi", "key_lo", F.col("_k").alias("_t")), ["key_hi", "key_lo"]).select("_v", "_t", F.lit(True).alias("exact"))
    return exact_pairs.unionByName(near_pairs).select(F.least("_v", "_t").alias(f"{key}_a"), F.greatest("_v", "_t").alias(f"{key}_b"), "exact")


def record_keys_of(canonical: DataFrame) -> DataFrame:
    """Canonical words with the keys of the record's class, which is the unordered pair of sides without blanks, and of its text."""
    squeezed = canonical.withColumns({"_x": F.replace("wa", F.lit(" "), F.lit("")), "_y": F.replace("wb", F.lit(" "), F.lit(""))})
    both, text = F.concat_ws("\x00", F.least("_x", "_y"), F.greatest("_x", "_y")), F.concat_ws("\x00", "wa", "wb")
    digest = lambda x: F.xxhash64(F.lit(1), F.sha2(x, 256))
    keys = {"key_hi": F.xxhash64(both), "key_lo": digest(both), "hi": F.xxhash64(text), "lo": digest(text)}
    return squeezed.withColumns(keys).drop("_x", "_y")


def overlap_report(df: DataFrame, key: str = "pair_id", by: tuple[str, ...] = ("logical_corpus", "source_provenance_raw"), validation: str = "is_validation_upstream", **texts: str) -> DataFrame:
    """Per split and ``by``: ``records`` that have a partner in the other split, and their ``exact_pairs`` and ``near_pairs``.

    Counted by classes and texts; pairs are not written out. Nulls in ``by`` form groups of their own.
    """
    members, linked = cross_split_links(df, key, validation=validation, **texts)
    sizes = lambda *by: members.groupBy(*by).agg(F.count_if("_val").alias("v"), F.count_if(~F.col("_val")).alias("t"))
    sides = F.inline(F.array(*(F.struct(F.lit(x).alias("_val"), F.col(c).alias("_e")) for x, c in ((True, "t"), (False, "v")))))
    exact = sizes("key_hi", "key_lo").where("v > 0 and t > 0").select("key_hi", "key_lo", sides)
    near_of = []
    for own, other, count in (("1", "2", "t"), ("2", "1", "v")):
        far = sizes("hi", "lo").select(F.col("hi").alias(f"hi{other}"), F.col("lo").alias(f"lo{other}"), F.col(count).alias("_n"))
        near_of.append(linked.join(far, [f"hi{other}", f"lo{other}"]).groupBy(F.col(f"hi{own}").alias("hi"), F.col(f"lo{own}").alias("lo")).agg(F.sum("_n").alias("_n")).withColumn("_val", F.lit(own == "1")))
    per = members.join(exact, ["key_hi", "key_lo", "_val"], "left").join(near_of[0].unionByName(near_of[1]), ["hi", "lo", "_val"], "left")
    per = per.select(F.col("_k").alias(key), F.coalesce("_e", F.lit(0)).alias("_e"), F.coalesce("_n", F.lit(0)).alias("_n")).where("_e > 0 or _n > 0")
    split = F.when(F.coalesce(F.col(validation), F.lit(False)), "validation").otherwise("training").alias("split")
    return df.select(key, validation, *by).join(per, key).groupBy(split, *by).agg(F.count("*").alias("records"), F.sum("_e").alias("exact_pairs"), F.sum("_n").alias("near_pairs"))
