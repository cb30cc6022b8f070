"""Deterministic samples: by hash order, disjoint by group, stratified with quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.col(key), F.lit(salt)))


def hash_sample(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The ``n`` keys of smallest salted hash: the same rows on any engine; a top-n, so no full sort."""
    return df.orderBy(stable_order(key, salt), key).limit(n)


def reservoir(df: DataFrame, key: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """A uniform sample of ``n`` rows without knowing their number, of each group if ``by`` is given.

    A reservoir that keeps the rows of smallest seeded random number is the same in any order and partitioning,
    and two reservoirs merge into that of both inputs. Each task keeps ``n`` rows a group at most.
    """
    if not by:
        return hash_sample(df, key, n, f"reservoir-{seed}")
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(stable_order(key, f"reservoir-{seed}"), key))  # Spark keeps n rows a group before the shuffle
    return df.withColumn("_k", ranked).where(F.col("_k") <= n).drop("_k")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """A pilot: the first rows by key."""
    return df.orderBy(key).limit(n)


def greedy_groups(df: DataFrame, key: str, groups: list[tuple[str, Column, list[Column]]], per_group: int, total: int, salt: str) -> DataFrame:
    """``key, chosen_as``: for each group in turn the first rows not chosen yet, then a backfill in hash order.

    Each group needs at most ``per_group`` rows beyond those that earlier groups may have
    taken, so one scan keeps, for each group, its first (number of groups * per_group) rows;
    choosing among these few is done in order. No loop over the data.
    """
    reach = per_group * len(groups)
    spots = [(name, p, [*order, stable_order(key, salt), F.col(key)]) for name, p, order in groups] + [("stable_hash_backfill", F.lit(True), [stable_order(key, salt), F.col(key)])]
    parts = None
    for i, (_, p, order) in enumerate(spots):
        depth = reach if i < len(groups) else reach + total
        one = df.where(p).orderBy(*order).limit(depth).select(key, F.lit(i).alias("_g"), F.row_number().over(Window.orderBy(*order)).alias("_r"))
        parts = one if parts is None else parts.unionByName(one)
    chosen: dict[str, str] = {}
    names = [s[0] for s in spots]
    taken = [0] * len(spots)
    for r in parts.orderBy("_g", "_r").collect():  # at most (groups + 1) * reach + total rows, whatever the data
        limit = per_group if r["_g"] < len(groups) else max(0, total - sum(taken[: len(groups)]))
        if r[key] not in chosen and taken[r["_g"]] < limit:
            chosen[r[key]] = names[r["_g"]]
            taken[r["_g"]] += 1
    return df.sparkSession.createDataFrame(list(chosen.items()), f"{key} {df.schema[key].dataType.simpleString()}, chosen_as string")


def stratified(df: DataFrame, strata: list[str], key: str, quota: int, salt: str) -> DataFrame:
    """Up to ``quota`` rows of each stratum, in hash order. A stratum's rows are cut to the quota before they meet: hash-split, then merged."""
    order = [stable_order(key, salt), F.col(key)]
    split = F.pmod(F.xxhash64(key), F.lit(32))
    first = df.withColumn("_s", split).withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_s").orderBy(*order))).where(F.col("_r") <= quota)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_r") <= quota).drop("_s", "_r")


def audit_sample(df: DataFrame, key: str, strata: list[str], score: str, stress: Column, salt: str, balanced: int = 40, extremes: int = 40, stressed: int = 20) -> DataFrame:
    """``key, chosen_as``: a balanced part over strata, the extremes of a score at both ends, a stressed part, then backfill: ``balanced + extremes + stressed`` rows in all, disjoint."""
    half = extremes // 2
    groups = [("highest", F.col(score).isNotNull(), [F.desc(score)]), ("lowest", F.col(score).isNotNull(), [F.asc(score)])]
    total = balanced + extremes + stressed
    even = stratified(df, strata, key, balanced, salt).withColumn("_turn", F.row_number().over(Window.partitionBy(*strata).orderBy(stable_order(key, salt), key)))
    even = even.orderBy("_turn", *strata).limit(balanced).select(key, F.lit("balanced").alias("chosen_as"))
    rest = df.join(even.select(key), key, "left_anti")
    tops = greedy_groups(rest, key, groups, half, extremes, salt).where("chosen_as <> 'stable_hash_backfill'")
    rest = rest.join(tops.select(key), key, "left_anti")
    last = greedy_groups(rest, key, [("stress", stress, [])], stressed, total - balanced - extremes, salt)
    return even.unionByName(tops).unionByName(last)
