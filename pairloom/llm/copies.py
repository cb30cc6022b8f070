"""Duplicates hidden by formatting: records equal but for blanks, case, punctuation, character forms and field order.

Texts stream through the skip-and-fold table into two rolling polynomial hashes;
canonical strings are never built. Rows whose hashes collide are compared with a
two-pointer scan before they count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .fold import blocks, code_digest, folder, poly_hashes, two_pointer_equal
from .sieve import passes, sieve_of

PART = 4096  # copies of one record compared in one part


def record_keys(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key, key_hi, key_lo``: a 128-bit number of the unordered pair of folded texts of each row."""
    schema = T.StructType([df.schema[key], T.StructField("key_hi", T.LongType()), T.StructField("key_lo", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in blocks([(x or "") + (y or "") for x, y in zip(a, c, strict=True)]):
                with np.errstate(over="ignore"):
                    one, two = (poly_hashes(*folder().fold(t[i:j])[:2]) for t in (a, c))
                    first = np.where(one[0] < two[0], 0, 1)
                    mix = [np.where(first == 0, x, y) * np.uint64(0xD6E8FEB86659FD93) + np.where(first == 0, y, x) for x, y in ((one[0], two[0]), (one[1], two[1]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(m.view(np.int64)) for m in mix)], names=[key, "key_hi", "key_lo"])

    return df.select(key, left, right).mapInArrow(run, schema)


@F.pandas_udf(T.BooleanType())
def same_record(a1, b1, a2, b2):  # noqa: ANN001, ANN201
    """Two-pointer comparison of two records, the sides in either order."""
    import pandas as pd

    both = zip(a1, b1, a2, b2, strict=True)
    return pd.Series([two_pointer_equal(p, r) and two_pointer_equal(q, s) or two_pointer_equal(p, s) and two_pointer_equal(q, r) for p, q, r, s in both], dtype=bool)


@F.pandas_udf(T.StringType())
def record_digest(a, b):  # noqa: ANN001, ANN201
    """SHA-256 of both sides' codes as they stream by, in order: only for rows whose hashes agree though their texts differ."""
    import pandas as pd

    return pd.Series(["".join(sorted(code_digest(x) for x in row)) for row in zip(a, b, strict=True)], dtype=object)


def format_copies(df: DataFrame, key: str = "pair_id", left: str = "ko_text_analysis", right: str = "en_text_analysis") -> DataFrame:
    """One row per record that is a copy: ``keep_<key>`` (the group's smallest key), ``copy_<key>``.

    ``key`` must be unique; rows whose key is null are left out, as they can't be named.
    Null text counts as empty, so two records with no letters or digits at all are
    copies of one another. Other columns of ``df`` are ignored, whatever their names.
    An empty table gives an empty result.
    """
    df = df.select(F.col(key).alias("_k"), F.col(left).alias("_a"), F.col(right).alias("_b")).where(F.col("_k").isNotNull())
    keys = cut(record_keys(df, "_k", "_a", "_b"))
    groups = keys.groupBy("key_hi", "key_lo").agg(F.min("_k").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    # Only key rows are shuffled to find the groups, then only texts of rows in groups.
    grouped = cut(keys.join(groups, ["key_hi", "key_lo"]).select("_k", "_keep", "_n", F.xxhash64("_k").alias("_h")))
    texts = df.where(passes(sieve_of(grouped, "_h", grouped.count()), F.xxhash64("_k")))
    # A large group is compared in parts, each with the keep's text.
    parts = F.ceil(F.col("_n") / PART)
    rows = grouped.join(texts, "_k").withColumn("_part", F.pmod("_h", parts))
    keeps = rows.where("_k = _keep").select("_keep", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"), F.col("_a").alias("_ka"), F.col("_b").alias("_kb"))
    checked = cut(
        rows.where("_k <> _keep")
        .join(keeps, ["_keep", "_part"])
        .withColumn("_same", same_record("_a", "_b", "_ka", "_kb"))
        .select("_k", "_keep", "_same", F.when(~F.col("_same"), F.struct("_a", "_b")).alias("_odd"))
    )
    good = checked.where("_same").select("_k", "_keep")
    # Texts that differ under one hash form groups of their own.
    odd = checked.where("not _same").select("_k", record_digest("_odd._a", "_odd._b").alias("_text"))
    odd_keeps = odd.groupBy("_text").agg(F.min("_k").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    odd = odd.join(odd_keeps, "_text").where("_k <> _keep").select("_k", "_keep")
    return good.unionByName(odd).select(F.col("_keep").alias(f"keep_{key}"), F.col("_k").alias(f"copy_{key}"))


def collapse(df: DataFrame, key: str = "pair_id", left: str = "ko_text_analysis", right: str = "en_text_analysis") -> DataFrame:
    """The table with one record per group of copies (the smallest key) and the number of its copies in ``n_copies``.

    Rows with a null key stay, with ``n_copies`` 1. A column of ``df`` named ``n_copies`` is replaced.
    """
    copies = format_copies(df, key, left, right)
    drop = copies.select(F.col(f"copy_{key}").alias(key))
    counts = copies.groupBy(F.col(f"keep_{key}").alias(key)).agg((F.count("*") + 1).alias("_n"))
    return df.drop("n_copies").join(drop, key, "left_anti").join(counts, key, "left").withColumn("n_copies", F.coalesce("_n", F.lit(1))).drop("_n")
