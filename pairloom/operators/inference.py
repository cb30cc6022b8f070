"""Signed-rank and sign tests, order-statistic intervals and bootstraps of medians over distinct-value counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import ranks

Z95 = 1.959964


def signed_rank(df: DataFrame, x: Column | str) -> DataFrame:
    """``n, zeros, w_plus, z, log10_p``: Wilcoxon's test with zeros dropped, average ranks and tie correction.

    Ranks come from counts of distinct absolute values; the normal tail beyond a double is by its series.
    """
    x = F.col(x) if isinstance(x, str) else x
    d = df.select(x.cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = d.where("x <> 0").groupBy(F.abs("x").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("x") > 0).alias("p"))
    c = ranks.running(counts.select(F.col("a").alias("value"), F.col("t").alias("n"), "p"))
    ranked = c.select(F.col("n").alias("t"), "p", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("r"))
    # Products of counts are formed in doubles: with billions of ties t**3 leaves a long.
    t = F.col("t").cast("double")
    s = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("r") * F.col("p")).alias("w_plus"), F.sum(t * t * t - t).alias("ties"))
    zeros = d.agg(F.count_if(F.col("x") == 0).alias("zeros"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)
    return s.join(zeros, F.lit(True)).withColumn("z", F.when(variance > 0, z)).select("n", "zeros", "w_plus", "z", log10_p("z").alias("log10_p"))


def log10_p(z: str) -> Column:
    """log10 of the two-sided normal p-value: the asymptotic series from |z| = 6 on, a rational fit below."""
    a = F.abs(F.col(z))
    t = 1 / (1 + 0.3275911 * a / math.sqrt(2))
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a / 2)
    tail = -a * a / 2 - F.ln(a) - 0.5 * math.log(2 * math.pi) + F.ln(1 - 1 / (a * a) + 3 / F.pow(a, 4) - 15 / F.pow(a, 6)) + math.log(2)
    return F.when(a < 6, F.log10(erfc)).otherwise(tail / math.log(10))


def sign_tests(df: DataFrame, x: Column | str, center: float = 0.0) -> DataFrame:
    """``positive, negative, ties, z_conditional, z_with_ties``: the sign test without ties, and with them in the denominator."""
    x = F.col(x) if isinstance(x, str) else x
    d = df.agg(F.count_if(x > center).alias("positive"), F.count_if(x < center).alias("negative"), F.count_if(x == center).alias("ties"))
    diff = (F.col("positive") - F.col("negative")).cast("double")
    m = F.col("positive") + F.col("negative")
    return d.withColumns({"z_conditional": diff / F.sqrt(F.nullif(m.cast("double"), F.lit(0.0))), "z_with_ties": diff / F.sqrt(F.nullif((m + F.col("ties")).cast("double"), F.lit(0.0)))})


def exact_sign_p(positive: int, negative: int) -> float:
    """Two-sided exact binomial p-value, summed in logarithms."""
    n, k = positive + negative, min(positive, negative)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(v - top) for v in logs))


def order_statistic_interval(df: DataFrame, x: Column | str) -> DataFrame:
    """``n, median, low, high``: the values at ranks n/2 -+ z sqrt(n)/2, from cumulative counts."""
    n = F.col("total")
    low = F.greatest(F.lit(1), F.floor(n / 2 - Z95 * F.sqrt(n.cast("double")) / 2))
    high = F.least(n, F.ceil(n / 2 + Z95 * F.sqrt(n.cast("double")) / 2) + 1)
    at = ranks.at_rank
    return ranks.running(ranks.value_counts(df, x)).agg(F.max("total").alias("n"), ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"), at(low).alias("low"), at(high).alias("high"))


BITS = 12  # of a value's 64 that one pass of the bootstrap follows


@dataclass
class _Search:
    """Where the middle of one resample is still looked for: below which leading bits, with how many drawn rows of each stratum, at which ranks among them."""

    replicate: int
    prefix: int
    drawn: np.ndarray
    ranks: tuple[int, ...]


def median_bootstrap(df: DataFrame, x: Column | str, replicates: int = 2000, seed: int = 1, by: list[str] | None = None) -> dict:
    """``median, low, high, replicates, n``: the median of the data, and the percentile interval of resampled medians.

    Exact at any size, and no rows or values reach the driver: how many rows of a resample fall on each of the 4,096 values
    of the next 12 bits is one multinomial draw for each stratum, so each resample is drawn only where its middle is. A pass
    fetches counts for the bits that are still followed, of which there are few, as the middles lie close together. ``by``:
    resampled within strata of fixed sizes, which should be some hundred at most. Without values all are NaN.
    """
    spread = ranks.value_counts(df, x, by).withColumn("stratum", F.to_json(F.struct(*by)) if by else F.lit(""))
    counts = cut(spread.select("value", "stratum", "n"))
    sizes = {r.stratum: r.n for r in counts.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
    strata, total = sorted(sizes), sum(sizes.values())
    if not total:
        return {"median": math.nan, "low": math.nan, "high": math.nan, "replicates": replicates, "n": 0}
    rng = np.random.default_rng(seed)
    middle = tuple(sorted({(total + 1) // 2, total // 2 + 1}))
    start = np.array([sizes[s] for s in strata])
    # Replicate 0 is the data itself, which is counted and not drawn.
    searches = [_Search(k, 0, start, middle) for k in range(replicates + 1)]
    found: list[list[float]] = [[] for _ in range(replicates + 1)]
    done = 0
    while searches:
        cells = _cells(counts, sorted({s.prefix for s in searches}), done, strata)
        following = []
        for prefix, group in _grouped(searches):
            digits, n, low, high = cells[prefix]
            per_digit = np.zeros((len(group), len(digits)), np.int64)
            drawn = np.zeros((len(group), len(digits), len(strata)), np.int64)
            for g in range(len(strata)):
                if n[:, g].sum():
                    drawn[:, :, g] = rng.multinomial([s.drawn[g] for s in group], n[:, g] / n[:, g].sum())
            for k, s in enumerate(group):
                if s.replicate == 0:
                    drawn[k] = n
            per_digit = drawn.sum(axis=2)
            upto = per_digit.cumsum(axis=1)
            for k, s in enumerate(group):
                at = np.searchsorted(upto[k], s.ranks)
                for d in np.unique(at).tolist():
                    left = tuple(int(r - (upto[k, d] - per_digit[k, d])) for r, c in zip(s.ranks, at, strict=True) if c == d)
                    if low[d] == high[d]:
                        found[s.replicate] += [low[d]] * len(left)
                    else:
                        following.append(_Search(s.replicate, prefix << BITS | int(digits[d]), drawn[k, d], left))
        searches = following
        done += BITS
    medians = np.array([sum(f) / len(f) for f in found])
    low, high = np.percentile(medians[1:], [2.5, 97.5])
    return {"median": float(medians[0]), "low": float(low), "high": float(high), "replicates": replicates, "n": total}


def _grouped(searches: list[_Search]) -> list[tuple[int, list[_Search]]]:
    groups: dict[int, list[_Search]] = {}
    for s in searches:
        groups.setdefault(s.prefix, []).append(s)
    return sorted(groups.items())


def _cells(counts: DataFrame, prefixes: list[int], done: int, strata: list[str]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each leading bits followed: the next digits in rising order, their counts by stratum, and the least and greatest value of each."""
    wanted = np.array(prefixes, np.uint64)
    width = min(BITS, 64 - done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = ranks.ordered_bits(b.column(0).to_numpy(zero_copy_only=False))
            prefix = bits >> np.uint64(64 - done) if done else np.zeros(len(bits), np.uint64)
            keep = np.isin(prefix, wanted)
            digit = (bits[keep] << np.uint64(done)) >> np.uint64(64 - width) << np.uint64(BITS - width)
            yield pa.RecordBatch.from_arrays([pa.array(prefix[keep].view(np.int64)), pa.array(digit.astype(np.int32)), *(c.filter(pa.array(keep)) for c in b.columns)], names=["prefix", "digit", "value", "stratum", "n"])

    d = counts.select("value", "stratum", "n").mapInArrow(run, "prefix long, digit int, value double, stratum string, n long")
    rows = d.groupBy("prefix", "digit", "stratum").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).toPandas()
    out = {}
    for prefix, r in rows.groupby("prefix"):
        digits, at = np.unique(r["digit"], return_inverse=True)
        n, low, high = np.zeros((len(digits), len(strata)), np.int64), np.full(len(digits), np.inf), np.full(len(digits), -np.inf)
        n[at, np.searchsorted(strata, r["stratum"].to_numpy(str))] = r["n"]
        np.minimum.at(low, at, r["low"])
        np.maximum.at(high, at, r["high"])
        out[int(np.int64(prefix).view(np.uint64))] = (digits, n, low, high)
    return out


def subset_stability(df: DataFrame, x: str, subsets: dict[str, Column]) -> DataFrame:
    """``subset, n, median, positive, negative`` of overlapping subsets, in one scan."""
    member = F.filter(F.array(*(F.when(p, F.lit(k)) for k, p in subsets.items())), lambda v: v.isNotNull())
    d = df.select(F.explode(member).alias("subset"), F.col(x).alias("_x")).where("_x is not null")
    c = ranks.running(ranks.value_counts(d, "_x", ["subset"]), ["subset"])
    total = lambda p: F.sum(F.when(p, F.col("n")).otherwise(0))
    return c.groupBy("subset").agg(F.max("total").alias("n"), ranks.quantile(0.5).alias("median"), total(F.col("value") > 0).alias("positive"), total(F.col("value") < 0).alias("negative"))
