"""Queries of inference and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference as inf
from ..operators import models as ml
from ..operators import ranks as rk
from ..operators import validate as va
from ..session import cut, table
from .registry import query
from .measure_queries import TOKENS, latest_tokens
from .relation_queries import COHORT_FROM, cohort


@query(
    f"""WITH d AS (SELECT log_token_premium AS x FROM ({TOKENS}) WHERE log_token_premium IS NOT NULL), c AS (SELECT abs(x) AS a, count(*) AS t, count(*) FILTER (WHERE x > 0) AS p FROM d WHERE x <> 0 GROUP BY a),
r AS (SELECT *, sum(t) OVER (ORDER BY a) - t + (t + 1) / 2.0 AS r FROM c), s AS (SELECT sum(t)::DOUBLE AS n, sum(r * p) AS w, sum(t::DOUBLE * t * t - t) AS ties FROM r)
SELECT n::BIGINT AS n, (SELECT count(*) FROM d WHERE x = 0) AS zeros, w::DOUBLE AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s"""
)
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.signed_rank(latest_tokens(spark, sf_dir, ["log_token_premium"]), "log_token_premium").select("n", "zeros", "w_plus", F.round("z", 6).alias("z"))


@query(f"SELECT p AS positive, m AS negative, t AS ties, round((p - m) / sqrt(p + m), 6) AS z_conditional, round((p - m) / sqrt(p + m + t), 6) AS z_with_ties FROM (SELECT count(*) FILTER (WHERE log_token_premium > 0) AS p, count(*) FILTER (WHERE log_token_premium < 0) AS m, count(*) FILTER (WHERE log_token_premium = 0) AS t FROM ({TOKENS}))")
def sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inf.sign_tests(latest_tokens(spark, sf_dir, ["log_token_premium"]), "log_token_premium")
    return d.withColumns({c: F.round(c, 6) for c in ("z_conditional", "z_with_ties")})


@query(
    f"""WITH o AS (SELECT token_premium AS v, row_number() OVER (ORDER BY token_premium) AS k, count(*) OVER () AS n FROM ({TOKENS}) WHERE token_premium IS NOT NULL)
SELECT max(n) AS n, round(quantile_cont(v, 0.5), 9) AS median, round(min(v) FILTER (WHERE k >= greatest(1, floor(n / 2 - 1.959964 * sqrt(n) / 2))), 9) AS low, round(min(v) FILTER (WHERE k >= least(n, ceil(n / 2 + 1.959964 * sqrt(n) / 2) + 1)), 9) AS high FROM o"""
)
def order_statistic_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inf.order_statistic_interval(latest_tokens(spark, sf_dir, ["token_premium"]), "token_premium")
    return d.select("n", *(F.round(c, 9).alias(c) for c in ("median", "low", "high")))


SUBSETS = {"all": "true", "known_direction": "translation_direction <> 'UNKNOWN'", "dialogue": "domain = 'dialogue'", "long": "length_stratum = 'Q5'"}


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS subset, count(*) AS n, round(quantile_cont(log_token_premium, 0.5), 9) AS median, count(*) FILTER (WHERE log_token_premium > 0) AS positive, count(*) FILTER (WHERE log_token_premium < 0) AS negative FROM ({TOKENS}) JOIN pair_registry USING (pair_id) WHERE log_token_premium IS NOT NULL AND {p}" for k, p in SUBSETS.items())
)
def subset_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = latest_tokens(spark, sf_dir, ["log_token_premium"]).join(table(spark, sf_dir, "pair_registry").select("pair_id", "translation_direction", "domain", "length_stratum"), "pair_id")
    return inf.subset_stability(d, "log_token_premium", {k: F.expr(p) for k, p in SUBSETS.items()}).withColumn("median", F.round("median", 9))


@query("SELECT '(intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS beta, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 8), count(*) FROM lineitem")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    fit = ml.ols(ml.gram(d, ["l_quantity"], ["l_extendedprice"]), "l_extendedprice")
    return ml.fit_table(spark, {"price": fit}).select("term", F.round("beta", 4).alias("beta"), F.round("r2", 8).alias("r2"), "n")


@query(
    """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*)::DOUBLE AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem),
u AS (SELECT (l_quantity - mx) * (l_extendedprice - a - b * l_quantity) AS u FROM lineitem, m)
SELECT 'l_quantity' AS term, round(any_value(b), 4) AS beta, round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(any_value(n) / (any_value(n) - 2)), 4) AS se FROM u, m"""
)
def robust_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    fit = ml.ols(ml.gram(d, ["l_quantity"], ["l_extendedprice"]), "l_extendedprice")
    row = ml.hc1(d, fit)[1]
    return spark.createDataFrame([(row["term"], round(row["beta"], 4), round(row["se"], 4))], "term string, beta double, se double")


@query("""WITH c AS (SELECT source_id, domain, count(*) AS n FROM pair_registry WHERE source_id IS NOT NULL AND domain IS NOT NULL GROUP BY ALL), g AS (SELECT a.source_id, b.domain FROM (SELECT DISTINCT source_id FROM c) a, (SELECT DISTINCT domain FROM c) b)
SELECT source_id, domain, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'EMPTY' ELSE 'NEAR_SINGLETON' END AS verdict FROM g LEFT JOIN c USING (source_id, domain) WHERE coalesce(n, 0) < 100""")
def thin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.identifiability(table(spark, sf_dir, "pair_registry"), "source_id", "domain", 100)


@query("SELECT count(DISTINCT source_id) AS levels_a, count(DISTINCT logical_corpus) AS levels_b, count(*) AS pairs, count(DISTINCT source_id) = count(*) AND count(DISTINCT logical_corpus) = count(*) AS bijective FROM (SELECT DISTINCT source_id, logical_corpus FROM pair_registry WHERE source_id IS NOT NULL AND logical_corpus IS NOT NULL)")
def source_corpus_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.bijection(table(spark, sf_dir, "pair_registry"), "source_id", "logical_corpus")


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The cohort with numeric columns and one-hot factors, written once: models read it in several passes."""
    d = cut(cohort(spark, sf_dir))
    hot = {k: c for f in ("domain", "translation_direction") for k, c in ml.one_hot(f, ml.levels_by_count(d, f)).items()}
    size = F.expr("0.5D * (ln(ko_codepoint_count) + ln(en_codepoint_count))")
    return d.withColumns({"pair_log_size": size, **hot}), ["pair_log_size", "ko_latin_share", "ko_digit_share", "morpheme_density", "particle_ratio", *hot]


@query()
def model_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested models of both outcomes from one pass: size, then script shares, then morphology and factors."""
    d, x = _matrix(spark, sf_dir)
    outcomes = ["log_token_premium", "log_compression_penalty"]
    g = ml.gram(d, x, outcomes)
    steps = {"size": x[:1], "scripts": x[:3], "full": x}
    return ml.fit_table(spark, {f"{y}:{k}": ml.ols(g, y, cols) for y in outcomes for k, cols in steps.items()})


@query()
def nested_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = _matrix(spark, sf_dir)
    g = ml.gram(d, x, ["log_token_premium"])
    full = ml.ols(g, "log_token_premium")
    rows = [(k, *(float(v) for v in ml.nested(full, ml.ols(g, "log_token_premium", cols)).values())) for k, cols in {"without_morphology": [c for c in x if c not in ("morpheme_density", "particle_ratio")], "size_only": x[:1]}.items()]
    return spark.createDataFrame(rows, "comparison string, delta_r2 double, partial_r2 double, lr_chi2 double, df double")


@query()
def subset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model on several row subsets, all products in one pass."""
    d, x = _matrix(spark, sf_dir)
    subsets = {"all": F.lit(True), "corpus_025": F.col("logical_corpus") == "025", "known_direction": F.col("translation_direction") != "UNKNOWN"}
    grams = ml.subset_grams(d, x, ["log_token_premium"], subsets)
    return ml.fit_table(spark, {k: ml.ols(g, "log_token_premium") for k, g in grams.items()})


@query()
def wild_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients with robust and bootstrap intervals."""
    import numpy as np

    d, x = _matrix(spark, sf_dir)
    fit = ml.ols(ml.gram(d, x, ["log_token_premium"]), "log_token_premium")
    draws = ml.wild_bootstrap(d, fit, "pair_id", 500, 20260817)
    low, high = np.percentile(draws, [2.5, 97.5], axis=0)
    rows = [(r["term"], r["beta"], r["se"], r["low"], r["high"], float(a), float(b)) for r, a, b in zip(ml.hc1(d, fit), low, high, strict=True)]
    return spark.createDataFrame(rows, "term string, beta double, se double, low double, high double, boot_low double, boot_high double")


@query()
def huber_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = _matrix(spark, sf_dir)
    got = ml.huber(d.select("log_token_premium", *(F.col(f"`{c}`") for c in x)), x[:5], "log_token_premium")
    return spark.createDataFrame([(t, float(b), float(got["sigma"])) for t, b in zip(got["terms"], got["beta"], strict=True)], "term string, beta double, sigma double")


@query()
def collinearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = _matrix(spark, sf_dir)
    return spark.createDataFrame([tuple(r.values()) for r in ml.collinearity(ml.gram(d, x, []))], "term string, vif double, `condition` double, triggered boolean")


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = _matrix(spark, sf_dir)
    got = ml.principal_components(ml.gram(d, x[:5], []), 2)
    return spark.createDataFrame([(t, float(v[0]), float(v[1])) for t, v in got["loadings"].items()], "term string, pc1 double, pc2 double")


def _bootstraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(cohort(spark, sf_dir).select("token_premium", "source_id"))
    rows = [(k, *(float(v) for v in inf.median_bootstrap(d, "token_premium", 2000, 1, by).values())) for k, by in (("plain", None), ("within_source", ["source_id"]))]
    return spark.createDataFrame(rows, "kind string, median double, low double, high double, replicates double, n double")


@query()
def median_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of the median premium, plain and within sources."""
    return _bootstraps(spark, sf_dir)


@query(
    f"""WITH o AS (SELECT token_premium AS v, row_number() OVER (ORDER BY token_premium) AS k, count(*) OVER () AS n {COHORT_FROM}), m AS (SELECT max(n)::DOUBLE AS n, quantile_cont(v, 0.5) AS median FROM o)
SELECT unnest(['plain', 'within_source']) AS kind, n, round(median, 9) AS median, true AS around_the_median, true AS as_wide_as_its_ranks FROM m"""
)
def median_bootstrap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap's median and rows, and whether its interval is what resampling gives: around the median, and within the values four standard errors of its rank away."""
    d = cohort(spark, sf_dir).select("token_premium")
    n, at = F.col("total"), rk.at_rank
    wide = lambda s: F.least(n, F.greatest(F.lit(1), F.floor(n / 2 + s * 2 * F.sqrt(n.cast("double")))))
    bounds = rk.running(rk.value_counts(d, "token_premium")).agg(at(wide(-1)).alias("least"), at(wide(1)).alias("most"))
    b = _bootstraps(spark, sf_dir).join(bounds, F.lit(True))
    return b.select("kind", "n", F.round("median", 9).alias("median"), F.expr("low <= median and median <= high").alias("around_the_median"), F.expr("least <= low and high <= most").alias("as_wide_as_its_ranks"))
