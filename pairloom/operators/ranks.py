"""Exact ranks and quantiles from counts of distinct values, spread over value ranges: no window or buffer holds a whole column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64  # value ranges of a group
ACCURACY = 10_000  # of the approximate quantiles that only choose ranges


def value_counts(df: DataFrame, x: Column | str, by: list[str] | None = None) -> DataFrame:
    """``<by>, value, n``: how often each value occurs, as doubles; nulls and NaN are left out."""
    x = F.col(x) if isinstance(x, str) else x
    return df.select(*(by or []), x.cast("double").alias("value")).where("value is not null and not isnan(value)").groupBy(*(by or []), "value").agg(F.count("*").alias("n"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which nulls are equal, each key kept once."""
    if not keys:
        return left.join(right, F.lit(True))
    r = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]).drop(*(f"_r{i}" for i in range(len(keys))))


def running(counts: DataFrame, by: list[str] | None = None, parts: int = PARTS, **of_group: Column) -> DataFrame:
    """``counts`` (``<by>, value, n``) plus ``upto``, the rows up to and with each value, and ``total``, those of the group.

    Each group's values are parted at approximate quantiles; ranges are summed on their own and add the exact sums of
    those below. ``of_group``: aggregates over the group's counts, as further columns.
    """
    by = by or []
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], ACCURACY).alias("_cuts"), F.sum("n").alias("total"), *(a.alias(k) for k, a in of_group.items()))
    # How many cuts are at most the value, by halving: generated code, unlike a function over the array.
    d = _joined(counts, cuts, by).withColumn("_p", F.lit(0))
    for step in (1 << k for k in reversed(range((parts - 1).bit_length()))):
        d = d.withColumn("_p", F.col("_p") + F.when(F.get("_cuts", F.col("_p") + (step - 1)) <= F.col("value"), step).otherwise(0))
    d = d.drop("_cuts")
    group = by or [F.lit(0)]
    sizes = d.groupBy(*by, "_p").agg(F.sum("n").alias("_s"))
    below = sizes.withColumn("_below", F.sum("_s").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_s")).drop("_s")  # one row a range
    inside = d.withColumn("_in", F.sum("n").over(Window.partitionBy(*by, "_p").orderBy("value")))
    return _joined(inside, below, [*by, "_p"]).withColumn("upto", F.col("_below") + F.col("_in")).drop("_p", "_below", "_in")


def at_rank(rank: Column) -> Column:
    """Aggregate over ``running``: the value of the row of this rank, counted from 1."""
    return F.min(F.when(F.col("upto") >= rank, F.col("value")))


def quantile(p: float) -> Column:
    """Aggregate over ``running``: the p-th quantile, interpolated between neighbouring ranks."""
    at = F.lit(float(p)) * (F.col("total") - 1)
    part = F.max(at - F.floor(at))
    lo, hi = at_rank(F.floor(at) + 1), at_rank(F.ceil(at) + 1)
    return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)


def quantiles(df: DataFrame, x: Column | str, ps: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``<by>, n`` and an exact interpolated quantile for each name in ``ps``; groups without values have no row, without ``by`` there is always one."""
    return running(value_counts(df, x, by), by).groupBy(*(by or [])).agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), *(quantile(p).alias(k) for k, p in ps.items()))


DIGIT = 16


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def exact_median(df: DataFrame, x: Column) -> float | None:
    """The median of a column by passes that move counts only: each follows the next 16 bits of the middle values, until these are one value.

    Nulls and NaN are left out; None without values. Two passes are the rule, four the most.
    """
    d = df.select(x.cast("double").alias("value")).where("value is not null and not isnan(value)")
    following: dict[int, list[int]] = {0: []}  # leading bits, and the ranks looked for among the values that have them
    found: list[float] = []
    for done in range(0, 64, DIGIT):
        rows = _digits(d, sorted(following), done)
        if not done:
            n = int(rows["n"].sum())
            if not n:
                return None
            following[0] = [(n + 1) // 2, n // 2 + 1]
        deeper: dict[int, list[int]] = {}
        for prefix, wanted in following.items():
            r = rows[rows["prefix"] == prefix].sort_values("digit")
            upto = r["n"].cumsum().to_numpy()
            for rank in wanted:
                at = int(np.searchsorted(upto, rank))
                low, high = r["low"].iloc[at], r["high"].iloc[at]
                if low == high:
                    found.append(float(low))
                else:
                    deeper.setdefault(prefix << DIGIT | int(r["digit"].iloc[at]), []).append(rank - int(upto[at] - r["n"].iloc[at]))
        following = deeper
        if not following:
            break
    return sum(found) / len(found)


def _digits(d: DataFrame, prefixes: list[int], done: int) -> pd.DataFrame:
    """``prefix, digit, n, low, high``: for each leading bits followed, the counts and ends of the values by their next 16 bits, at most 65,536 rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(prefixes), 1 << DIGIT), np.int64)
        low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for b in batches:
            value = b.column(0).to_numpy(zero_copy_only=False)
            bits = ordered_bits(value)
            for k, prefix in enumerate(prefixes):
                keep = bits >> np.uint64(64 - done) == np.uint64(prefix) if done else np.ones(len(bits), bool)
                digit = ((bits[keep] << np.uint64(done)) >> np.uint64(64 - DIGIT)).astype(np.int64)
                n[k] += np.bincount(digit, minlength=1 << DIGIT)
                np.minimum.at(low[k], digit, value[keep])
                np.maximum.at(high[k], digit, value[keep])
        k, digit = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(digit.astype(np.int32)), *(pa.array(x[k, digit]) for x in (n, low, high))], names=["k", "digit", "n", "low", "high"])

    parts = d.mapInArrow(run, "k int, digit int, n long, low double, high double")
    rows = parts.groupBy("k", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    return rows.assign(prefix=[prefixes[k] for k in rows["k"]])
