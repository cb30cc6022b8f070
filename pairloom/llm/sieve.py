"""Sieves: which 64-bit numbers occur, in an array of bits that grows with their number up to a fixed size.

A sieve only spares a shuffle rows that can't match; results are the same without it. At its
greatest size it is 8 MB, so the driver may hold and broadcast it whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import scramble

LEAST_BITS, MOST_BITS = 20, 26


class Sieve:
    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        at = places(numbers, self.bits)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def places(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (scramble(numbers.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def size_for(numbers: int) -> int:
    """Bits of a sieve for about so many numbers: eight cells or more for each, between the two bounds."""
    return min(max((8 * max(numbers, 1)).bit_length(), LEAST_BITS), MOST_BITS)


class Filling:
    """A sieve being filled in one task, given out as the words that are not 0."""

    def __init__(self, bits: int) -> None:
        self.bits, self.set = bits, np.zeros(1 << bits, bool)

    def add(self, numbers: np.ndarray) -> None:
        self.set[places(numbers, self.bits)] = True

    def batch(self) -> pa.RecordBatch:
        words = np.packbits(self.set, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["word", "bits"])


def merged(words: DataFrame, bits: int) -> Sieve:
    """The sieve of ``word int, bits long`` rows, merged before they come to the driver."""
    rows = words.where("word >= 0").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Sieve(bits, out)


def sieve_of(df: DataFrame, column: str, numbers: int) -> object:
    """The broadcast sieve of a column of longs."""
    bits = size_for(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filling(bits)
        for b in batches:
            f.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield f.batch()

    return df.sparkSession.sparkContext.broadcast(merged(df.select(column).mapInArrow(run, "word int, bits long"), bits))


def passes(sieve: object, number: Column | str) -> Column:
    """Whether the sieve holds a long; only this number leaves the JVM."""

    @F.pandas_udf(T.BooleanType())
    def check(x: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.holds(x.to_numpy(np.int64)))

    return check(number)
