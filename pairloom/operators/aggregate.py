"""Distributions, histograms, crosstabs, correlations and profiles."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import ranks

Columns = dict[str, Column | str]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``<keep>, feature, value``: columns as rows, as doubles."""
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*(keep or []), pairs)


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per feature (and group): count, exact interpolated quantiles, moments, zero count, Tukey fence.

    All from counts of distinct values, which are spread over value ranges: no buffer holds a group's values.
    """
    keys = [*(by or []), "feature"]
    c = ranks.running(ranks.value_counts(long_values(df, columns, by), "value", keys), keys, _mean=F.sum(F.col("n") * F.col("value")) / F.sum("n"))
    names = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    squares = F.sum(F.col("n") * (F.col("value") - F.col("_mean")) ** 2)
    n = F.max("total")
    d = c.groupBy(*keys).agg(
        n.alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.max("_mean").alias("mean"), F.sqrt(F.when(n > 1, squares / (n - 1))).alias("sd"),
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("zeros"), *(ranks.quantile(p).alias(k) for k, p in names.items()),
    )
    iqr = F.col("p75") - F.col("p25")
    return d.withColumns({"iqr": iqr, "upper_fence": F.col("p75") + 1.5 * iqr, "zero_iqr": iqr == 0})


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, upper_fence, outliers``: values above the Tukey fence, two passes."""
    fences = describe(df, columns).select("feature", "upper_fence")
    long = long_values(df, columns).where("value is not null and not isnan(value)")
    return long.join(fences, "feature").groupBy("feature", "upper_fence").agg(F.count_if(F.col("value") > F.col("upper_fence")).alias("outliers"))


def bin_of(x: Column | str, low: float, width: float, bins: int) -> Column:
    """The bin of a value, values beyond the ends in the end bins."""
    return F.least(F.greatest(F.floor((_c(x) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, x: Column | str, low: float, width: float, bins: int) -> DataFrame:
    return df.where(_c(x).isNotNull()).groupBy(bin_of(x, low, width, bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: Column | str, y: Column | str, low: float, width: float, bins: int) -> DataFrame:
    return df.where(_c(x).isNotNull() & _c(y).isNotNull()).groupBy(bin_of(x, low, width, bins).alias("bin_x"), bin_of(y, low, width, bins).alias("bin_y")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """Counts of two keys, one column for each level, 0 where there are none."""
    return df.groupBy(row).pivot(column, levels).agg(F.count(F.lit(1))).na.fill(0)


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, levels, entropy``: bits of the level shares; null is a level."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("level")) for c in columns))))
    n = long.groupBy("dimension", "level").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))
    return p.groupBy("dimension").agg(F.count("*").alias("levels"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def counts_of(df: DataFrame, predicates: dict[str, Column], label: str = "rule") -> DataFrame:
    """``label, n``: how many rows meet each named predicate, in one scan; null is not met."""
    one = df.agg(*(F.count_if(p).alias(f"_{i}") for i, p in enumerate(predicates.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias(label), F.col(f"_{i}").alias("n")) for i, k in enumerate(predicates)))))


def regions(df: DataFrame, named: dict[str, Column], value: Column | str) -> DataFrame:
    """``region, n, median``: overlapping named regions in one scan, each row once for each region it is in."""
    member = F.filter(F.array(*(F.when(p, F.lit(k)) for k, p in named.items())), lambda x: x.isNotNull())
    d = df.select(F.explode(member).alias("region"), _c(value).alias("_v"))
    medians = ranks.quantiles(d, "_v", {"median": 0.5}, ["region"]).select("region", "median")
    return d.groupBy("region").agg(F.count("*").alias("n")).join(medians, "region", "left")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: Pearson correlation of all pairs of columns over all rows, in one scan."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def average_ranks(df: DataFrame, x: Column | str, by: list[str] | None = None, parts: int = ranks.PARTS) -> DataFrame:
    """``<by>, value, n, rank``: each distinct value with the mean rank of its rows; nulls and NaN are left out."""
    c = ranks.running(ranks.value_counts(df, x, by), by, parts)
    return c.select(*(by or []), "value", "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``rho, n``: Pearson correlation of average ranks over rows with both values; constant columns give null."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.count("*").alias("w"))

    # Both columns' values are ranked together, as two groups.
    long = both.select("w", F.inline(F.array(F.struct(F.lit("x").alias("feature"), F.col("x").alias("value")), F.struct(F.lit("y").alias("feature"), F.col("y").alias("value")))))
    r = ranks.running(long.groupBy("feature", "value").agg(F.sum("w").alias("n")), ["feature"])
    ranked = r.select("feature", "value", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("r"))
    of = lambda c: ranked.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("r").alias(f"r{c}"))
    d = both.join(of("x"), "x").join(of("y"), "y")
    n, sx, sy = F.sum("w"), F.sum(F.col("w") * F.col("rx")), F.sum(F.col("w") * F.col("ry"))
    s = d.agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(a + b) for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry"))))
    cov = F.col("rxry") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("rxrx") - F.col("sx") ** 2 / F.col("n"), F.col("ryry") - F.col("sy") ** 2 / F.col("n")
    return s.select(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"), "n")


def rank_correlations(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """``family, a, b, rho``: Spearman correlation of all pairs of columns within each family, over rows that have the numbers of all families.

    Average ranks of all columns come from their value counts together; they are joined back by value. A constant column gives null.
    """
    columns = list(dict.fromkeys(c for f in families.values() for c in f))
    d = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).where(reduce(and_, (F.col(c).isNotNull() & ~F.isnan(c) for c in columns)))
    ranked = cut(average_ranks(long_values(d, columns), "value", ["feature"]))
    for i, c in enumerate(columns):
        d = d.join(ranked.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_r{i}")), c)
    r = {c: F.col(f"_r{i}") for i, c in enumerate(columns)}
    pairs = [(k, a, b) for k, f in families.items() for a, b in combinations(f, 2)]
    varies = lambda c: F.min(r[c]) < F.max(r[c])  # noqa: E731 (sums over tasks leave a constant's variance a little above 0)
    one = d.agg(*(F.when(varies(a) & varies(b), F.corr(r[a], r[b])).alias(f"_{i}") for i, (_, a, b) in enumerate(pairs)))
    rows = (F.struct(F.lit(k).alias("family"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("rho")) for i, (k, a, b) in enumerate(pairs))
    return one.select(F.inline(F.array(*rows)))


def nearest_rank_quantiles(df: DataFrame, x: Column | str, ps: list[float]) -> DataFrame:
    """``p, value``: nearest-rank quantiles of a table of value counts; none for no values."""
    c = ranks.running(ranks.value_counts(df, x))
    picks = c.agg(*(ranks.at_rank(F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(p))))).alias(f"_{i}") for i, p in enumerate(ps)))
    return picks.select(F.inline(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.col(f"_{i}").alias("value")) for i, p in enumerate(ps))))).where("value is not null")


def profile(df: DataFrame, columns: list[str], top: int = 25) -> DataFrame:
    """``field, absent, empty, present, distinct_values, top_values`` of string columns: the commonest ones by count, then value."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))))
    n = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    heads = n.where("value is not null").withColumn("k", rank).where(F.col("k") <= top).groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "; ").alias("top_values"))
    sums = n.groupBy("field").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("absent"), F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0)).alias("empty"), F.sum(F.when(F.col("value") != "", F.col("n")).otherwise(0)).alias("present"), F.count("value").alias("distinct_values"))
    return sums.join(heads, "field", "left")


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """``field, absent, nulls, empty, strings, numbers, booleans, arrays, objects, distinct_values`` of the fields of a column of JSON objects.

    A field that a record lacks is absent; one that is there as null is not. Rows without an object are no records. Distinct
    values are those of scalars, as they are spelled.
    """
    records = df.select(F.try_parse_json(column).alias("v")).where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"))
    parts = records.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("field"), F.col("value"), F.schema_of_variant("value").alias("kind"))
    kinds = {"strings": F.col("kind") == "STRING", "numbers": F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "booleans": F.col("kind") == "BOOLEAN", "arrays": F.col("kind").startswith("ARRAY"), "objects": F.col("kind").startswith("OBJECT")}
    scalar = F.when(~kinds["arrays"] & ~kinds["objects"] & (F.col("kind") != "VOID"), F.col("value").cast("string"))
    counted = parts.withColumn("s", scalar).groupBy("field").agg(
        F.count("*").alias("_there"), F.count_if(F.col("kind") == "VOID").alias("nulls"), F.count_if(kinds["strings"] & (F.col("s") == "")).alias("empty"), *(F.count_if(c).alias(k) for k, c in kinds.items()), F.count_distinct("s").alias("distinct_values")
    )
    total = records.agg(F.count("*").alias("_total"))
    return counted.join(total, F.lit(True)).select("field", (F.col("_total") - F.col("_there")).alias("absent"), "nulls", "empty", *kinds, "distinct_values")


def support(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, levels, rows, verdict`` of each level: how far the two factors can be told apart.

    ZERO_VARIANCE: the level has one level of the other factor, and that one occurs
    nowhere else; STRUCTURALLY_CONFOUNDED: one level, shared; PARTIALLY_IDENTIFIABLE:
    not all; IDENTIFIABLE: all.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    owners = cells.groupBy(column).agg(F.count("*").alias("_o"))
    total = cells.select(column).distinct().agg(F.count("*").alias("_all"))
    per = cells.join(owners, column).groupBy(row).agg(F.count("*").alias("levels"), F.sum("n").alias("rows"), F.max("_o").alias("_o"))
    verdict = F.when((F.col("levels") == 1) & (F.col("_o") == 1), "ZERO_VARIANCE").when(F.col("levels") == 1, "STRUCTURALLY_CONFOUNDED").when(F.col("levels") < F.col("_all"), "PARTIALLY_IDENTIFIABLE").otherwise("IDENTIFIABLE")
    return per.join(total, F.lit(True)).select(row, "levels", "rows", verdict.alias("verdict"))


def tiles(df: DataFrame, x: str, tie: str, n: int) -> DataFrame:
    """``df`` plus ``tile``: equal-sized tiles of the total order (x, tie), numbered from 1. As ``quality.length_strata``: no window over all rows."""
    from ..functions.quality import length_strata

    return length_strata(df, F.col(x), tie, n, "tile")
