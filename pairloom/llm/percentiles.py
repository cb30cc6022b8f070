"""Percentiles per group by radix selection over pieces that can be combined.

A double becomes an integer of the same order. A piece is a day's signed histogram
of such integers per group: a value counts +1 on the day it was measured and -1 on
the day a later measurement of the same pair replaces it, so the sum of the pieces
up to any day is the histogram as of that day. Selection reads 16 bits at a time
and follows only the digits that hold a wanted rank.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

DIGIT = 16
PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99)
SIGN = np.int64(-(1 << 63))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers whose unsigned order is that of the doubles; both zeros are one."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ SIGN)


def from_ordered_bits(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return np.where(k < 0, k ^ SIGN, ~k).view(np.float64)


@F.pandas_udf(T.LongType())
def _key(x: pd.Series) -> pd.Series:
    return pd.Series(ordered_bits(x.to_numpy(np.float64, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def _value(k: pd.Series) -> pd.Series:
    return pd.Series(from_ordered_bits(k.to_numpy(np.int64)))


def day_pieces(measured: DataFrame, groups: DataFrame, by: list[str], key: str, value: str, at: str, bits: int = 64) -> DataFrame:
    """``day, <by>, digits, n``: the pieces of ``measured``.

    Of a key's rows the latest counts (of the same moment, the greater value); where
    that is null or NaN the key has no value. Each key's rows are first reduced to one a
    day, so a key with very many rows is no burden. ``groups`` has ``key`` and ``by``;
    keys it lacks are left out, null groups are groups. ``bits``: how many leading bits
    are kept; with fewer than 64 a value is off by at most 2**(12 - bits) of itself, or of the least normal double if that is more.
    """
    last = F.max(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("x")))
    daily = measured.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.to_date(at).alias("day")).agg(last.alias("l")).select("_k", "day", "l.x")
    until = daily.withColumn("gone", F.lead("day").over(Window.partitionBy("_k").orderBy("day"))).where("x is not null and not isnan(x)")
    signed = until.select("_k", F.inline(F.array(F.struct("day", F.lit(1).cast("long").alias("n")), F.struct(F.col("gone").alias("day"), F.lit(-1).cast("long").alias("n")))), "x").where("day is not null")
    mask = F.lit(-1 << (64 - bits)).cast("long") if bits < 64 else F.lit(-1).cast("long")
    named = groups.select(F.col(key).alias("_k"), *by)
    return signed.join(named, "_k").select("day", *by, _key("x").bitwiseAND(mask).alias("digits"), "n").groupBy("day", *by, "digits").agg(F.sum("n").alias("n")).where("n <> 0")


def combine(*pieces: DataFrame) -> DataFrame:
    """Pieces of different days or partitions as one."""
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    cols = [c for c in out.columns if c != "n"]
    return out.groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")


def select_percentiles(pieces: DataFrame, by: list[str], percentiles: tuple[float, ...] = PERCENTILES, bits: int = 64) -> DataFrame:
    """``<by>, percentile, value, n, error_bound`` over all days of ``pieces``.

    Interpolated between neighbouring ranks. ``error_bound``: how far ``value`` may be
    from the percentile of the full doubles (0 with 64 bits, else 2**(12 - bits) of the greater neighbour, or of the least normal double).
    Groups without values have no rows.
    """
    named = {c: f"_g{i}" for i, c in enumerate(by)}
    g = list(named.values())
    state = cut(pieces.groupBy(*(F.col(c).alias(n) for c, n in named.items()), "digits").agg(F.sum("n").alias("n")).where("n > 0"))
    total = state.groupBy(*g).agg(F.sum("n").alias("total"))
    ps = F.explode(F.array(*(F.lit(p) for p in percentiles))).alias("p")
    at = F.col("p") * (F.col("total") - 1)
    wanted = total.select(*g, "total", ps).select(*g, "total", "p", F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank")).distinct()
    targets = wanted.withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")})
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    levels = -(-bits // DIGIT)
    for level in range(levels):
        shift = 64 - DIGIT * (level + 1)
        here = state.withColumns({"prefix": F.shiftrightunsigned("digits", shift + DIGIT) if level else F.lit(0).cast("long"), "digit": F.shiftrightunsigned("digits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))})
        if level:
            kept = targets.select(*g, "prefix").distinct()
            here = here.alias("h").join(kept.alias("k"), same("h", "k", [*g, "prefix"]), "left_semi")
        hist = here.groupBy(*g, "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(*g, "prefix").orderBy("digit")))
        hit = targets.alias("t").join(upto.alias("u"), [*same("t", "u", [*g, "prefix"]), F.col("t.left") < F.col("u.upto"), F.col("t.left") >= F.col("u.upto") - F.col("u.n")])
        targets = hit.select(*(f"t.{c}" for c in g), "t.total", "t.p", "t.rank", (F.col("t.left") - (F.col("u.upto") - F.col("u.n"))).alias("left"), F.shiftleft("t.prefix", DIGIT).bitwiseOR(F.col("u.digit")).alias("prefix"))
        targets = cut(targets)
    found = targets.withColumn("x", _value(F.shiftleft("prefix", 64 - DIGIT * levels)))
    step = found.groupBy(*g, "total", "p").agg(F.min_by("x", "rank").alias("lo"), F.max_by("x", "rank").alias("hi"), F.min("rank").alias("rank"))
    part = F.col("p") * (F.col("total") - 1) - F.col("rank")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - part) + F.col("hi") * part)
    bound = F.lit(0.0) if bits >= 64 else F.greatest(F.abs("lo"), F.abs("hi"), F.lit(sys.float_info.min)) * F.lit(2.0 ** (12 - bits))
    return step.select(*(F.col(n).alias(c) for c, n in named.items()), F.col("p").alias("percentile"), value.alias("value"), F.col("total").alias("n"), bound.alias("error_bound"))



def readable(pieces: DataFrame) -> DataFrame:
    """Pieces with the value that their digits stand for in place of the digits."""
    return pieces.withColumn("value", _value("digits")).drop("digits")
