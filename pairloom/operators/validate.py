"""Checks that fail closed: artifacts, rules, completeness, identities, round trips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hashing import schema_fingerprint, set_fingerprint
from ..functions.text import is_finite


class Violation(ValueError):
    """A check that must hold doesn't."""


def assert_artifact(df: DataFrame, key: str, rows: int | None = None, columns: int | None = None, fold: object = None, schema: str | None = None) -> DataFrame:
    """``df`` itself, if row count, distinct keys, columns, set fingerprint and schema are as stated; there is no fallback."""
    got = set_fingerprint(df, key).first()
    total = df.count() if rows is not None else got.n
    wanted = {"rows": (rows, total), "null keys": (0, total - got.n), "distinct keys": (got.n, got.n_distinct), "columns": (columns, len(df.columns)), "fold": (fold, got.fold), "schema": (schema, schema_fingerprint(df))}
    wrong = {k: v for k, v in wanted.items() if v[0] is not None and v[0] != v[1]}
    if wrong:
        raise Violation(f"expected and found: {wrong}")
    return df


def unmapped(df: DataFrame, value: str, table: list[str]) -> DataFrame:
    """``value, n``: labels that a mapping lacks; nulls aside."""
    return df.where(F.col(value).isNotNull() & ~F.col(value).isin(*table)).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, columns: list[str], positive: list[str] = ()) -> DataFrame:
    """``column, nulls, not_finite, not_positive`` in one scan; ``not_positive`` (null for others) of columns whose logarithm is taken."""
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [F.count_if(x.isNull()).alias(f"{c}\x00nulls"), F.count_if(x.isNotNull() & ~is_finite(x)).alias(f"{c}\x00bad"), F.count_if(x <= 0).alias(f"{c}\x00low")]
    one = df.agg(*aggregates)
    rows = (F.struct(F.lit(c).alias("column"), F.col(f"`{c}\x00nulls`").alias("nulls"), F.col(f"`{c}\x00bad`").alias("not_finite"), (F.col(f"`{c}\x00low`") if c in positive else F.lit(None).cast("long")).alias("not_positive")) for c in columns)
    return one.select(F.inline(F.array(*rows)))


def identity_errors(df: DataFrame, identities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``identity, max_abs_error`` of each pair of expressions that should agree, in one scan."""
    one = df.agg(*(F.max(F.abs(a - b)).alias(f"_{i}") for i, (a, b) in enumerate(identities.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("identity"), F.col(f"_{i}").cast("double").alias("max_abs_error")) for i, k in enumerate(identities)))))


def differing_fields(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``field, differing`` of two tables of one key: rows in which a common column differs, nulls and NaN being equal to themselves; and, as ``(rows)``, keys that only one has.

    An optimized path is refused unless all are 0. Keys must be unique in each.
    """
    fields = [c for c in a.columns if c in b.columns and c != key]
    x = a.select(F.col(key).alias("_k"), F.struct(*fields).alias("_a"))
    y = b.select(F.col(key).alias("_k"), F.struct(*fields).alias("_b"))
    d = x.join(y, "_k", "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = {"(rows)": F.count_if(~both)} | {f: F.count_if(both & ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}"))) for f in fields}
    one = d.agg(*(c.alias(f"_{i}") for i, c in enumerate(counts.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"_{i}").alias("differing")) for i, k in enumerate(counts)))))


def order_breaks(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows, breaks``: in an explicit total order, how many rows have a value below that of the row before; a null is below nothing.

    Rows are sorted in ranges, each range is compared within itself, and each with the last value of the range before.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).alias("v"))
    kind = ranged.schema["v"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = breaks = 0
        first = last = pa.nulls(1).cast(to_arrow_type(kind))
        for b in batches:
            if b.num_rows:
                v = b.column(0)
                breaks += sum(pc.sum(pc.less(y, x)).as_py() or 0 for x, y in ((v[:-1], v[1:]), (last, v[:1])) if len(x))
                first = v[:1] if not rows else first
                rows, last = rows + b.num_rows, v[-1:]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64()), pa.array([breaks], pa.int64()), first, last], names=["part", "n", "b", "first", "last"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("b", T.LongType()), T.StructField("first", kind), T.StructField("last", kind)])
    parts = ranged.mapInArrow(run, schema)  # one row a range
    between = (F.col("first") < F.lag("last").over(Window.orderBy("part"))).cast("int")
    return parts.withColumn("c", F.coalesce(between, F.lit(0))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("b") + F.col("c")), F.lit(0)).alias("breaks"))


def biconditional(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``a, b, both, equivalent``: whether two conditions hold of the same rows."""
    d = df.agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both"))
    return d.withColumn("equivalent", (F.col("a") == F.col("b")) & (F.col("a") == F.col("both")))


def failures(checks: DataFrame, observed: str = "n", expected: int = 0) -> DataFrame:
    """Checks of a (rule, n) table whose count isn't the expected one."""
    return checks.where(F.col(observed) != expected)


def contract_problems(seeds: dict[str, int], versions: dict[str, tuple[object, object]], permissions: dict[str, bool]) -> list[str]:
    """What is wrong across contracts: seeds that are no unsigned 32-bit numbers or equal, versions that differ, permissions that are granted."""
    wrong = [f"seed {k} is no 32-bit number" for k, v in seeds.items() if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < 2**32]
    if len(set(seeds.values())) < len(seeds):
        wrong.append("two seeds are equal")
    wrong += [f"version of {k}: {a} and {b}" for k, (a, b) in versions.items() if a != b]
    return wrong + [f"permission {k} is granted" for k, v in permissions.items() if v is not False]


def identifiability(df: DataFrame, a: str, b: str, least: int = 1000) -> DataFrame:
    """``a, b, n, verdict`` of each combination of levels that is empty or has fewer than ``least`` rows.

    Levels of model factors are few; the grid has as many rows as combinations of levels.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = cells.select(a).distinct().join(cells.select(b).distinct(), F.lit(True))
    full = grid.join(cells, [a, b], "left").fillna(0, ["n"])
    return full.where(F.col("n") < least).withColumn("verdict", F.when(F.col("n") == 0, "EMPTY").otherwise("NEAR_SINGLETON"))


def bijection(df: DataFrame, a: str, b: str) -> DataFrame:
    """``levels_a, levels_b, pairs, bijective``: whether two columns name the same thing."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct().agg(F.count_distinct(a).alias("levels_a"), F.count_distinct(b).alias("levels_b"), F.count("*").alias("pairs"))
    return d.withColumn("bijective", (F.col("levels_a") == F.col("pairs")) & (F.col("levels_b") == F.col("pairs")))
