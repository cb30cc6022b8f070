"""Joins, set operations and comparisons of relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine_join(spine: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of several tables on one key: partitioned once by it. Columns that clash with the spine's are dropped from the others."""
    out = spine
    for o in others:
        out = out.join(o.drop(*(c for c in o.columns if c in out.columns and c != key)), key)
    return out


def lost_rows(spine: DataFrame, joined: DataFrame) -> DataFrame:
    """``spine_rows, joined_rows, lost``: whether a join kept the spine."""
    n = lambda d, c: d.agg(F.count("*").alias(c))
    return n(spine, "spine_rows").join(n(joined, "joined_rows"), F.lit(True)).withColumn("lost", F.col("spine_rows") - F.col("joined_rows"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``side, n``: keys that only one of two tables has."""
    only = lambda a, b, s: a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))


def differing_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and, for each column, whether it differs, of keys in both tables where any does; null equals null."""
    a, b = old.select(key, *columns).alias("a"), new.select(key, *columns).alias("b")
    marks = [(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs") for c in columns]
    d = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}"), *marks)
    return d.where(reduce(lambda x, y: x | y, (F.col(f"{c}_differs") for c in columns)))


def sidecar(base: DataFrame, extra: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Columns of a sidecar merged in, in a given order."""
    return base.join(extra, key).select(*order)


def excluded(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``df`` less the listed keys."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def overlap_matrix(df: DataFrame, category: str, digest: str | Column) -> DataFrame:
    """``dim_a, dim_b, rows_a, distinct_a, dup_rows_a, shared_distinct``: per category its rows and distinct digests, per pair of categories the shared ones.

    Digests are first reduced to (category, digest), then each digest's set of
    categories gives its pairs: no self-join, and a digest in very many rows is one row.
    Null categories are left out; null digests count as rows only.
    """
    d = df.where(F.col(category).isNotNull()).select(F.col(category).alias("_c"), (F.col(digest) if isinstance(digest, str) else digest).alias("_d"))
    per = d.groupBy("_c", "_d").agg(F.count("*").alias("_n"))
    diagonal = per.groupBy("_c").agg(F.sum("_n").alias("rows_a"), F.count("_d").alias("distinct_a")).select(
        F.col("_c").alias("dim_a"), F.col("_c").alias("dim_b"), "rows_a", "distinct_a", (F.col("rows_a") - F.col("distinct_a")).alias("dup_rows_a"), F.lit(None).cast("long").alias("shared_distinct")
    )
    sets = per.where("_d is not null").groupBy("_d").agg(F.sort_array(F.collect_set("_c")).alias("_s")).where(F.size("_s") > 1).groupBy("_s").agg(F.count("*").alias("_n"))
    pairs = sets.select(F.explode("_s").alias("dim_a"), "_s", "_n").select("dim_a", F.explode("_s").alias("dim_b"), "_n").where("dim_a < dim_b")
    shared = pairs.groupBy("dim_a", "dim_b").agg(F.sum("_n").alias("shared_distinct"))
    null = F.lit(None).cast("long")
    return diagonal.unionByName(shared.select("dim_a", "dim_b", null.alias("rows_a"), null.alias("distinct_a"), null.alias("dup_rows_a"), "shared_distinct"))


def matchable(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``matchable``: rows of two tables that can be matched one to one by key."""
    a, b = (d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)) for d, n in ((left, "_a"), (right, "_b")))
    return a.join(b, key).agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0)).alias("matchable"))


def group_resolved(df: DataFrame, group: str = "duplicate_group_id", key: str = "pair_id") -> DataFrame:
    """Per group of equal pairs: representative and conflicts. Nulls never conflict; ``min <> max`` needs no distinct sets."""
    conflict = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return df.groupBy(group).agg(
        F.min(key).alias("representative_pair_id"), F.count("*").alias("group_rows"), F.min("translation_direction_raw").alias("single_direction"),
        conflict("translation_direction_raw").alias("direction_conflict_flag"), conflict("domain").alias("domain_conflict_flag"),
        conflict("source_id").alias("source_id_conflict_flag"), conflict("source_provenance_raw").alias("source_provenance_raw_conflict_flag"),
    )


def resolved_registry(staging: DataFrame, group: str = "duplicate_group_id") -> DataFrame:
    """The registry with group columns and the resolved direction: the single direction of a group, else UNKNOWN with a review flag."""
    g = group_resolved(staging, group)
    s = staging.drop(*(c for c in g.columns if c != group), "translation_direction")
    direction = F.when(F.col("direction_conflict_flag") | F.col("single_direction").isNull(), "UNKNOWN").otherwise(F.col("single_direction"))
    return s.join(g, group).withColumn("translation_direction", direction).withColumn("translation_direction_review_flag", F.coalesce("translation_direction_review_flag", F.lit(False)) | F.col("direction_conflict_flag"))


def duplicate_metrics(df: DataFrame, category: str, group: str) -> DataFrame:
    """Per category: rows after the first of a group, groups with more than one."""
    return df.groupBy(category, group).agg(F.count("*").alias("_n")).where("_n > 1").groupBy(category).agg(F.sum(F.col("_n") - 1).alias("duplicate_rows_after_first"), F.count("*").alias("duplicate_groups"))


def mechanism(df: DataFrame, digest: str, category: str, levels: tuple[str, str]) -> DataFrame:
    """How duplicates arise between two levels of a category: rows repeated within one, rows matched across."""
    a, b = levels
    per = df.groupBy(digest).agg(F.count_if(F.col(category) == a).alias("_a"), F.count_if(F.col(category) == b).alias("_b"))
    return per.agg(
        F.sum(F.greatest(F.col("_a") - 1, F.lit(0))).alias("within_first"), F.sum(F.greatest(F.col("_b") - 1, F.lit(0))).alias("within_second"),
        F.sum(F.least("_a", "_b")).alias("across"), F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("shared_distinct"),
    )


def multiplicity(df: DataFrame, digest: str) -> DataFrame:
    """``copies, digests``: how many digests occur how often."""
    return df.groupBy(digest).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("digests"))


def seen_before(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """``df`` plus ``seen_before``: whether its digest occurs in an earlier row of the order. The first row is a minimum, so no window gathers a digest's rows."""
    at = F.struct(*order)
    first = df.groupBy(digest).agg(F.min(at).alias("_first"))
    return df.withColumn("_at", at).join(first.withColumnRenamed(digest, "_d"), F.col(digest).eqNullSafe(F.col("_d"))).withColumn("seen_before", F.col("_at") > F.col("_first")).drop("_at", "_first", "_d")


def share_within(counts: DataFrame, n: str, by: list[str] | None = None, out: str = "share") -> DataFrame:
    """The share of each row of an aggregate in its group's total."""
    return counts.withColumn(out, F.col(n) / F.sum(n).over(Window.partitionBy(*(by or []))))


def latest_rows(df: DataFrame, key: str, at: str, ties: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each key: of the latest moment, then the greatest by ``ties``. An aggregate with map-side combine, so a key in very many rows is no burden."""
    kept = [c for c in (columns or df.columns) if c != key]
    best = F.max_by(F.struct(*kept), F.struct(at, *ties)).alias("_m")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(f"_m.{c}" for c in kept))
