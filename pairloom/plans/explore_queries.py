"""Queries of exploration: distributions, histograms, crosstabs, correlations, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as ag
from ..operators import ranks as rk
from ..operators import sampling as sm
from ..session import table
from .registry import query
from .identity_queries import COHORT
from .measure_queries import TOKENS, latest_tokens
from .relation_queries import COHORT_FROM, cohort

FEATURES = ["ko_codepoint_count", "en_codepoint_count", "ko_whitespace_density", "ko_digit_share", "en_script_switch_count"]
Q = "[0.05, 0.25, 0.5, 0.75, 0.95, 0.99]"
LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v{{by}} FROM rep_features{{frm}}" for c in FEATURES)


def _describe_sql(by: str = "", source: str = "") -> str:
    long = LONG.format(by=f", {by}" if by else "", frm=source)
    keep = f"{by}, " if by else ""
    return f"""WITH l AS ({long}), d AS (SELECT {keep}feature, count(*) AS n, min(v) AS "min", max(v) AS "max", quantile_cont(v, {Q}) AS q, avg(v) AS mean, stddev_samp(v) AS sd, count(*) FILTER (WHERE v = 0) AS zeros FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY {keep}feature)
SELECT {keep}feature, n, round("min", 6) AS "min", round("max", 6) AS "max", round(mean, 6) AS mean, round(sd, 6) AS sd, zeros, round(q[1], 6) AS p05, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p95, round(q[6], 6) AS p99,
  round(q[4] - q[2], 6) AS iqr, round(q[4] + 1.5 * (q[4] - q[2]), 6) AS upper_fence, round(q[4] - q[2], 9) = 0 AS zero_iqr FROM d"""


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes)).withColumn("zero_iqr", F.round("iqr", 9) == 0)


@query(_describe_sql())
def feature_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ag.describe(table(spark, sf_dir, "rep_features"), FEATURES))


@query(_describe_sql("domain", " JOIN pair_registry USING (pair_id)"))
def stratified_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rep_features").join(table(spark, sf_dir, "pair_registry").select("pair_id", "domain"), "pair_id")
    return _rounded(ag.describe(d, FEATURES, ["domain"]))


@query("SELECT d.feature, round(upper_fence, 6) AS upper_fence, count(*) FILTER (WHERE v > upper_fence) AS outliers FROM (SELECT feature, quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS upper_fence FROM (" + LONG.format(by="", frm="") + ") WHERE v IS NOT NULL GROUP BY feature) d JOIN (" + LONG.format(by="", frm="") + ") l ON l.feature = d.feature WHERE v IS NOT NULL GROUP BY ALL")
def tukey_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.outliers(table(spark, sf_dir, "rep_features"), FEATURES).withColumn("upper_fence", F.round("upper_fence", 6))


@query(f"SELECT least(greatest(floor((log_token_premium + 1) / 0.05), 0), 39)::INT AS bin, count(*) AS n FROM ({TOKENS}) WHERE log_token_premium IS NOT NULL GROUP BY bin")
def premium_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(latest_tokens(spark, sf_dir, ["log_token_premium"]), "log_token_premium", -1.0, 0.05, 40)


@query(f"SELECT least(greatest(floor(log2(ko_token_count) / 0.5), 0), 29)::INT AS bin_x, least(greatest(floor(log2(en_token_count) / 0.5), 0), 29)::INT AS bin_y, count(*) AS n FROM ({TOKENS}) WHERE ko_token_count > 0 AND en_token_count > 0 GROUP BY ALL")
def token_histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["ko_token_count", "en_token_count"]).where("ko_token_count > 0 and en_token_count > 0")
    return ag.histogram_2d(t, F.log2("ko_token_count"), F.log2("en_token_count"), 0.0, 0.5, 30)


@query(f"SELECT sign(log_token_premium)::INT AS tp, sign(log_code_point_ratio)::INT AS cr, sign(log_byte_density_ratio)::INT AS bdr, sign(log_compression_penalty)::INT AS cp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({TOKENS}) GROUP BY ALL")
def sign_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relations import share_within

    names = {"tp": "log_token_premium", "cr": "log_code_point_ratio", "bdr": "log_byte_density_ratio", "cp": "log_compression_penalty"}
    t = latest_tokens(spark, sf_dir, list(names.values()))
    n = t.groupBy(*(F.signum(c).cast("int").alias(k) for k, c in names.items())).agg(F.count("*").alias("n"))
    return share_within(n, "n").withColumn("share", F.round("share", 9))


@query("SELECT domain, count(*) FILTER (WHERE translation_direction = 'KO_TO_EN') AS KO_TO_EN, count(*) FILTER (WHERE translation_direction = 'EN_TO_KO') AS EN_TO_KO, count(*) FILTER (WHERE translation_direction = 'UNKNOWN') AS \"UNKNOWN\" FROM pair_registry GROUP BY domain")
def domain_direction_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.crosstab(table(spark, sf_dir, "pair_registry"), "domain", "translation_direction", ["KO_TO_EN", "EN_TO_KO", "UNKNOWN"])


DIMENSIONS = ["domain", "source_id", "translation_direction", "sentence_type", "logical_corpus"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, '(null)') AS level, count(*) AS n FROM pair_registry GROUP BY ALL" for c in DIMENSIONS) + "), p AS (SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS p FROM c) SELECT dimension, count(*) AS levels, round(-sum(p * log2(p)), 9) + 0.0 AS entropy FROM p GROUP BY dimension")
def level_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.entropy(table(spark, sf_dir, "pair_registry"), DIMENSIONS).withColumn("entropy", F.round("entropy", 9) + 0.0)


@query(
    f"""SELECT CASE WHEN ko_eojeol_count <= 3 THEN '1-3' WHEN ko_eojeol_count <= 6 THEN '4-6' WHEN ko_eojeol_count <= 10 THEN '7-10' WHEN ko_eojeol_count <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n,
  round(quantile_cont(token_premium, 0.5), 6) AS p50, round(quantile_cont(token_premium, 0.9), 6) AS p90 {COHORT_FROM} GROUP BY bucket"""
)
def eojeol_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ko_eojeol_count")
    bucket = F.when(c <= 3, "1-3").when(c <= 6, "4-6").when(c <= 10, "7-10").when(c <= 20, "11-20").otherwise("21+")
    q = rk.quantiles(cohort(spark, sf_dir).select(bucket.alias("bucket"), "token_premium"), "token_premium", {"p50": 0.5, "p90": 0.9}, ["bucket"])
    return q.withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


CORR = ["log_token_premium", "log_code_point_ratio", "log_byte_density_ratio", "log_compression_penalty"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ({TOKENS})" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.correlations(latest_tokens(spark, sf_dir, CORR), CORR).withColumn("r", F.round("r", 6))


@query(
    f"""WITH d AS (SELECT ko_codepoint_count::DOUBLE AS x, log_token_premium AS y {COHORT_FROM}), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.spearman(cohort(spark, sf_dir).withColumn("ko_codepoint_count", F.col("ko_codepoint_count").cast("double")), "ko_codepoint_count", "log_token_premium").withColumn("rho", F.round("rho", 6))


@query("SELECT value, count(*) AS n, any_value(rank) AS rank FROM (SELECT ko_codepoint_count::DOUBLE AS value, rank() OVER (ORDER BY ko_codepoint_count) + (count(*) OVER (PARTITION BY ko_codepoint_count) - 1) / 2.0 AS rank FROM rep_features WHERE ko_codepoint_count IS NOT NULL) GROUP BY value")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.average_ranks(table(spark, sf_dir, "rep_features"), "ko_codepoint_count")


@query("WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT p, min(n_chars) AS value FROM o, (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p) WHERE k >= greatest(1, ceil(n * p)) GROUP BY p")
def nearest_rank_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.nearest_rank_quantiles(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.9, 0.95, 0.99])


FIELDS = ["domain", "source", "lang", "logical_corpus"]


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM documents GROUP BY ALL" for f in FIELDS)
    + """), k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM c WHERE value IS NOT NULL)
SELECT field, sum(CASE WHEN value IS NULL THEN n ELSE 0 END)::BIGINT AS absent, sum(CASE WHEN value = '' THEN n ELSE 0 END)::BIGINT AS empty, sum(CASE WHEN value <> '' THEN n ELSE 0 END)::BIGINT AS present, count(value) AS distinct_values,
  (SELECT string_agg(value || '=' || n, '; ' ORDER BY k) FROM k WHERE k.field = c.field AND k <= 25) AS top_values FROM c GROUP BY field"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.profile(table(spark, sf_dir, "documents"), FIELDS, 25)


@query(f"SELECT CASE WHEN token_premium < 1 THEN 'below' WHEN token_premium < 1.5 THEN 'body' ELSE 'tail' END AS band, count(*) AS n, round(avg(token_premium), 6) AS mean_premium FROM ({TOKENS}) GROUP BY band")
def body_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("token_premium")
    return latest_tokens(spark, sf_dir, ["token_premium"]).groupBy(F.when(c < 1, "below").when(c < 1.5, "body").otherwise("tail").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean_premium"))


THRESHOLDS = {"latin": "ko_latin_share > 0.1", "digit": "ko_digit_share > 0.1", "symbol": "ko_symbol_other_share > 0", "mixed": "ko_script_type_count >= 2", "url": "ko_url_flag", "email": "ko_email_flag", "emoji": "ko_emoji_flag"}


@query("SELECT domain, count(*) AS n, " + ", ".join(f"round(avg(({p})::INT), 9) AS {k}" for k, p in THRESHOLDS.items()) + " FROM rep_features JOIN pair_registry USING (pair_id) GROUP BY domain")
def threshold_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rep_features").join(table(spark, sf_dir, "pair_registry").select("pair_id", "domain"), "pair_id")
    return d.groupBy("domain").agg(F.count("*").alias("n"), *(F.round(F.avg(F.expr(p).cast("int")), 9).alias(k) for k, p in THRESHOLDS.items()))


@query(f"SELECT round(avg((token_premium < 1)::INT), 9) AS below, round(avg((token_premium = 1)::INT), 9) AS equal, round(avg((token_premium > 1)::INT), 9) AS above, round(avg((code_point_ratio < 1 AND code_point_ratio * byte_density_ratio > 1)::INT), 9) AS reversed FROM ({TOKENS})")
def ratio_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["token_premium", "code_point_ratio", "byte_density_ratio"])
    share = lambda p: F.round(F.avg(p.cast("int")), 9)
    c = F.col("token_premium")
    return t.agg(share(c < 1).alias("below"), share(c == 1).alias("equal"), share(c > 1).alias("above"), share((F.col("code_point_ratio") < 1) & (F.col("code_point_ratio") * F.col("byte_density_ratio") > 1)).alias("reversed"))


@query(f"WITH ids AS (SELECT pair_id FROM pair_registry ORDER BY md5(pair_id || 'bridge') LIMIT 40) SELECT 'listed' AS basis, count(token_premium) AS n, round(quantile_cont(token_premium, 0.5), 6) AS median FROM ({TOKENS}) WHERE pair_id IN (SELECT pair_id FROM ids) UNION ALL SELECT 'all', count(token_premium), round(quantile_cont(token_premium, 0.5), 6) FROM ({TOKENS})")
def fixed_id_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistic over forty listed ids (the feature) and over all."""
    ids = sm.hash_sample(table(spark, sf_dir, "pair_registry").select("pair_id"), "pair_id", 40, "bridge")
    t = latest_tokens(spark, sf_dir, ["token_premium"])
    one = lambda d, s: rk.quantiles(d, "token_premium", {"median": 0.5}).select(F.lit(s).alias("basis"), "n", F.round("median", 6).alias("median"))
    return one(t.join(ids, "pair_id", "left_semi"), "listed").unionByName(one(t, "all"))


@query(
    """WITH c AS (SELECT source_id, domain, count(*) AS n FROM pair_registry WHERE source_id IS NOT NULL AND domain IS NOT NULL GROUP BY ALL), o AS (SELECT domain, count(*) AS o FROM c GROUP BY domain), p AS (SELECT source_id, count(*) AS levels, sum(n)::BIGINT AS "rows", max(o) AS o FROM c JOIN o USING (domain) GROUP BY source_id)
SELECT source_id, levels, "rows", CASE WHEN levels = 1 AND o = 1 THEN 'ZERO_VARIANCE' WHEN levels = 1 THEN 'STRUCTURALLY_CONFOUNDED' WHEN levels < (SELECT count(DISTINCT domain) FROM c) THEN 'PARTIALLY_IDENTIFIABLE' ELSE 'IDENTIFIABLE' END AS verdict FROM p"""
)
def source_domain_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.support(table(spark, sf_dir, "pair_registry"), "source_id", "domain")


REGIONS = {"short": "ko_codepoint_count < 20", "long": "ko_codepoint_count >= 100", "mixed_script": "ko_script_type_count >= 2", "all": "true"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS region, count(*) AS n, round(quantile_cont(pair_codepoint_ratio, 0.5), 6) AS median FROM rep_features WHERE {p} HAVING count(*) > 0" for k, p in REGIONS.items()))
def named_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.regions(table(spark, sf_dir, "rep_features"), {k: F.expr(p) for k, p in REGIONS.items()}, "pair_codepoint_ratio").withColumn("median", F.round("median", 6))


@query(f"SELECT tile, count(*) AS n, round(quantile_cont(log_token_premium, 0.5), 6) AS median FROM (SELECT log_token_premium, ntile(20) OVER (ORDER BY morpheme_density, pair_id) AS tile {COHORT_FROM} WHERE morpheme_density IS NOT NULL) GROUP BY tile")
def density_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ag.tiles(cohort(spark, sf_dir).where("morpheme_density is not null"), "morpheme_density", "pair_id", 20)
    return rk.quantiles(d, "log_token_premium", {"median": 0.5}, ["tile"]).withColumn("median", F.round("median", 6))


@query("SELECT pair_id FROM pair_registry ORDER BY md5(pair_id || 'audit-v1'), pair_id LIMIT 200")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.hash_sample(table(spark, sf_dir, "pair_registry").select("pair_id"), "pair_id", 200, "audit-v1")


@query("SELECT pair_id, domain FROM pair_registry ORDER BY pair_id LIMIT 100")
def pilot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.first_rows(table(spark, sf_dir, "pair_registry").select("pair_id", "domain"), "pair_id", 100)


@query("SELECT domain, pair_id FROM (SELECT domain, pair_id, row_number() OVER (PARTITION BY domain ORDER BY md5(pair_id || 'strata'), pair_id) AS k FROM pair_registry) WHERE k <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.stratified(table(spark, sf_dir, "pair_registry").select("domain", "pair_id"), ["domain"], "pair_id", 10, "strata")


@query(
    """WITH d AS (SELECT pair_id, domain, length(ko_text_analysis) AS n, md5(pair_id || 'greedy') AS h FROM pair_registry),
a AS (SELECT pair_id FROM d WHERE domain = 'general' ORDER BY h, pair_id LIMIT 10),
b AS (SELECT pair_id FROM d WHERE pair_id NOT IN (FROM a) ORDER BY n, h, pair_id LIMIT 10),
c AS (SELECT pair_id FROM d WHERE pair_id NOT IN (FROM a) AND pair_id NOT IN (FROM b) ORDER BY n DESC, h, pair_id LIMIT 10),
e AS (SELECT pair_id FROM d WHERE pair_id NOT IN (FROM a) AND pair_id NOT IN (FROM b) AND pair_id NOT IN (FROM c) ORDER BY h, pair_id LIMIT 20)
SELECT pair_id, 'general' AS chosen_as FROM a UNION ALL SELECT pair_id, 'shortest' FROM b UNION ALL SELECT pair_id, 'longest' FROM c UNION ALL SELECT pair_id, 'stable_hash_backfill' FROM e"""
)
def greedy_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").select("pair_id", "domain", F.length("ko_text_analysis").alias("n"))
    groups = [("general", F.col("domain") == "general", []), ("shortest", F.lit(True), [F.asc("n")]), ("longest", F.lit(True), [F.desc("n")])]
    return sm.greedy_groups(d, "pair_id", groups, 10, 50, "greedy")


@query(
    f"""WITH t AS (SELECT * FROM ({TOKENS})), d AS (SELECT p.pair_id, domain, script_mix_flag, token_premium, md5(p.pair_id || 'balanced') AS h FROM (SELECT * FROM pair_registry WHERE {COHORT}) p JOIN (SELECT pair_id, token_premium FROM t) USING (pair_id)),
a AS (SELECT pair_id, domain, row_number() OVER (PARTITION BY domain ORDER BY h, pair_id) AS turn FROM d), b AS (SELECT pair_id FROM a WHERE turn <= 40 ORDER BY turn, domain NULLS FIRST LIMIT 40),
r AS (SELECT * FROM d WHERE pair_id NOT IN (FROM b)), c AS (SELECT pair_id FROM r WHERE token_premium IS NOT NULL ORDER BY token_premium DESC, h, pair_id LIMIT 20),
e AS (SELECT pair_id FROM r WHERE token_premium IS NOT NULL AND pair_id NOT IN (FROM c) ORDER BY token_premium, h, pair_id LIMIT 20),
s AS (SELECT * FROM r WHERE pair_id NOT IN (FROM c) AND pair_id NOT IN (FROM e)), f AS (SELECT pair_id FROM s WHERE script_mix_flag ORDER BY h, pair_id LIMIT 20),
g AS (SELECT pair_id FROM s WHERE pair_id NOT IN (FROM f) ORDER BY h, pair_id LIMIT (20 - (SELECT count(*) FROM f)))
SELECT pair_id, 'balanced' AS chosen_as FROM b UNION ALL SELECT pair_id, 'highest' FROM c UNION ALL SELECT pair_id, 'lowest' FROM e UNION ALL SELECT pair_id, 'stress' FROM f UNION ALL SELECT pair_id, 'stable_hash_backfill' FROM g"""
)
def balanced_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred pairs: 40 balanced over domains, 40 of extreme premium, 20 with mixed scripts."""
    t = latest_tokens(spark, sf_dir, ["token_premium"])
    d = table(spark, sf_dir, "pair_registry").where(COHORT).select("pair_id", "domain", "script_mix_flag").join(t, "pair_id")
    return sm.audit_sample(d, "pair_id", ["domain"], "token_premium", F.col("script_mix_flag"), "balanced")
