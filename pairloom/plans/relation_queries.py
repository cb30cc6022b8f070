"""Queries over joins, set operations, cohorts and validation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregate as ag
from ..operators import relations as rl
from ..operators import validate as va
from ..session import table
from .registry import query
from .identity_queries import COHORT
from .measure_queries import MORPHS, TOKENS, _latest_morphs, latest_tokens

REPS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC NULLS LAST, ko_codepoint_count DESC NULLS LAST, en_codepoint_count DESC NULLS LAST) AS k FROM rep_features WHERE pair_id IS NOT NULL) WHERE k = 1"


def latest_reps(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return rl.latest_rows(table(spark, sf_dir, "rep_features"), "pair_id", "measured_at", ["ko_codepoint_count", "en_codepoint_count"], columns)


T_FIELDS = ["log_token_premium", "log_compression_penalty", "log_code_point_ratio", "log_byte_density_ratio", "token_premium"]
R_FIELDS = ["ko_codepoint_count", "en_codepoint_count", "ko_whitespace_density", "en_whitespace_density", "ko_latin_share", "ko_digit_share", "en_digit_share", "ko_script_switch_count", "ko_eojeol_count", "pair_byte_ratio"]
M_FIELDS = ["morpheme_density", "particle_ratio", "ending_ratio", "deriv_affix_ratio"]


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis matrix: tokens, registry, surface features and morphemes of each accepted pair, one row each. Only rows whose numbers are all there and finite."""
    t = latest_tokens(spark, sf_dir, T_FIELDS)
    p = table(spark, sf_dir, "pair_registry").where(COHORT).select("pair_id", "source_id", "domain", "translation_direction", "length_stratum", "logical_corpus")
    joined = rl.spine_join(t, [p, latest_reps(spark, sf_dir, R_FIELDS), _latest_morphs(spark, sf_dir, M_FIELDS)], "pair_id")
    return joined.where(reduce(and_, (tx.is_finite(c) for c in (*T_FIELDS, *R_FIELDS, *M_FIELDS))))


def _finite(sql: str, fields: list[str]) -> str:
    return f"SELECT * FROM ({sql}) WHERE " + " AND ".join(f"isfinite({c}::DOUBLE)" for c in fields)


COHORT_FROM = f"FROM ({_finite(TOKENS, T_FIELDS)}) t JOIN (SELECT pair_id, source_id, domain, translation_direction, length_stratum, logical_corpus FROM pair_registry WHERE {COHORT}) p USING (pair_id) JOIN ({_finite(REPS, R_FIELDS)}) r USING (pair_id) JOIN ({_finite(MORPHS, M_FIELDS)}) m USING (pair_id)"
SIZE = "0.5 * (ln(ko_codepoint_count) + ln(en_codepoint_count))"


@query(
    f"""SELECT pair_id, round(t.log_token_premium, 9) AS log_token_premium, round({SIZE}, 9) AS pair_log_size, round(r.ko_whitespace_density - r.en_whitespace_density, 9) AS delta_whitespace_density,
  r.ko_script_switch_count::DOUBLE AS ko_script_switch_count, round(m.morpheme_density, 9) AS morpheme_density, p.source_id || '-' || p.domain AS source_domain_cell {COHORT_FROM}"""
)
def analysis_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohort(spark, sf_dir)
    return d.select(
        "pair_id", F.round("log_token_premium", 9).alias("log_token_premium"), F.round(F.expr(SIZE.replace("0.5", "0.5D")), 9).alias("pair_log_size"), F.round(F.col("ko_whitespace_density") - F.col("en_whitespace_density"), 9).alias("delta_whitespace_density"),
        F.col("ko_script_switch_count").cast("double").alias("ko_script_switch_count"), F.round("morpheme_density", 9).alias("morpheme_density"), F.concat("source_id", F.lit("-"), "domain").alias("source_domain_cell"),
    )


@query(f"SELECT count(DISTINCT pair_id) AS spine_rows, (SELECT count(*) {COHORT_FROM}) AS joined_rows, count(DISTINCT pair_id) - (SELECT count(*) {COHORT_FROM}) AS lost FROM token_measurement WHERE pair_id IS NOT NULL")
def cohort_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.lost_rows(latest_tokens(spark, sf_dir, ["token_premium"]), cohort(spark, sf_dir))


@query("SELECT count(*) AS kept, (SELECT count(DISTINCT pair_id) FROM rep_features) AS feature_ids FROM pair_registry WHERE pair_id IN (SELECT pair_id FROM rep_features)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "rep_features").select("pair_id")
    kept = table(spark, sf_dir, "pair_registry").join(ids, "pair_id", "left_semi").agg(F.count("*").alias("kept"))
    return kept.join(ids.agg(F.count_distinct("pair_id").alias("feature_ids")), F.lit(True))


@query("SELECT 'registry_without_tokens' AS side, count(*) AS n FROM (SELECT pair_id FROM pair_registry EXCEPT SELECT pair_id FROM token_measurement) UNION ALL SELECT 'tokens_without_registry', count(*) FROM (SELECT pair_id FROM token_measurement EXCEPT SELECT pair_id FROM pair_registry)")
def except_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "pair_registry").select("pair_id"), table(spark, sf_dir, "token_measurement").select("pair_id")
    n = lambda d, s: d.agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return n(a.subtract(b), "registry_without_tokens").unionByName(n(b.subtract(a), "tokens_without_registry"))


@query(
    """WITH r AS (SELECT pair_id, morpheme_count, particle_count, morpheme_density, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at, morpheme_count) AS a, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC, morpheme_count DESC) AS z FROM morph_features)
SELECT o.pair_id, o.morpheme_count IS DISTINCT FROM n.morpheme_count AS morpheme_count_differs, o.particle_count IS DISTINCT FROM n.particle_count AS particle_count_differs
FROM (SELECT * FROM r WHERE a = 1) o JOIN (SELECT * FROM r WHERE z = 1) n USING (pair_id) WHERE o.morpheme_count IS DISTINCT FROM n.morpheme_count OR o.particle_count IS DISTINCT FROM n.particle_count"""
)
def null_safe_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "morph_features")
    at, row = F.struct("measured_at", "morpheme_count"), F.struct("morpheme_count", "particle_count")
    ends = m.groupBy("pair_id").agg(F.min_by(row, at).alias("o"), F.max_by(row, at).alias("n"))
    return rl.differing_rows(ends.select("pair_id", "o.*"), ends.select("pair_id", "n.*"), "pair_id", ["morpheme_count", "particle_count"])


@query("SELECT count(*) AS rows_left, count(*) FILTER (WHERE unicode_anomaly_flag) AS flagged_left FROM pair_registry WHERE pair_id NOT IN (SELECT pair_id FROM pair_registry WHERE unicode_anomaly_flag)")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    return rl.excluded(d, d.where("unicode_anomaly_flag"), "pair_id").agg(F.count("*").alias("rows_left"), F.count_if("unicode_anomaly_flag").alias("flagged_left"))


@query(f"SELECT pair_id, ko_codepoint_count, ko_grapheme_count, ko_token_count, en_token_count FROM ({REPS}) JOIN (SELECT pair_id, ko_token_count, en_token_count FROM ({TOKENS})) USING (pair_id)")
def sidecar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, extra = latest_reps(spark, sf_dir, ["ko_codepoint_count", "ko_grapheme_count"]), latest_tokens(spark, sf_dir, ["ko_token_count", "en_token_count"])
    return rl.sidecar(base, extra, "pair_id", ["pair_id", "ko_codepoint_count", "ko_grapheme_count", "ko_token_count", "en_token_count"])


GATE = ["morpheme_density", "particle_ratio", "eojeol_count", "morpheme_count"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} IS NOT NULL AND NOT isfinite({c}::DOUBLE)) AS not_finite, {'count(*) FILTER (WHERE ' + c + ' <= 0)' if c.endswith('count') else 'NULL::BIGINT'} AS not_positive FROM morph_features" for c in GATE))
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.completeness(table(spark, sf_dir, "morph_features"), GATE, [c for c in GATE if c.endswith("count")])


SHARES = ("hangul_share", "latin_share", "digit_share", "punctuation_share", "symbol_other_share", "whitespace_density")
IDENTITIES = {
    "byte_ratio_log": ("ln(pair_byte_ratio)", "log_code_point_ratio + log_byte_density_ratio"), "codepoint_ratio_exp": ("pair_codepoint_ratio", "exp(log_code_point_ratio)"),
    "premium_sum": ("log_token_premium", "log_code_point_ratio + log_byte_density_ratio + log_compression_penalty"), "tokens_per_byte": ("ln(ko_tokens_per_byte) - ln(en_tokens_per_byte)", "log_compression_penalty"),
    "tokens_per_codepoint": ("ln(ko_tokens_per_codepoint) - ln(en_tokens_per_codepoint)", "log_token_premium - log_code_point_ratio"), "whitespace_count": ("ko_whitespace_count", "ko_whitespace_density * ko_codepoint_count"),
    "ko_shares": (" + ".join(f"ko_{s}" for s in SHARES), "1"), "en_shares": (" + ".join(f"en_{s}" for s in SHARES), "1"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS identity, round(max(abs(({a}) - ({b}))), 6)::DOUBLE AS max_abs_error FROM ({REPS}) JOIN (SELECT * EXCLUDE (k, measured_at) FROM ({TOKENS})) USING (pair_id)" for k, (a, b) in IDENTITIES.items()))
def structural_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["log_token_premium", "log_code_point_ratio", "log_byte_density_ratio", "log_compression_penalty", "ko_tokens_per_byte", "en_tokens_per_byte", "ko_tokens_per_codepoint", "en_tokens_per_codepoint"])
    r = latest_reps(spark, sf_dir, ["pair_byte_ratio", "pair_codepoint_ratio", "ko_whitespace_count", "ko_codepoint_count", *(f"{x}_{s}" for x in ("ko", "en") for s in SHARES)])
    found = va.identity_errors(r.join(t, "pair_id"), {k: (F.expr(a), F.expr(b)) for k, (a, b) in IDENTITIES.items()})
    return found.withColumn("max_abs_error", F.round("max_abs_error", 6))


READY = {"premium_positive": "token_premium > 0", "density_present": "morpheme_density IS NOT NULL AND NOT isnan(morpheme_density)", "codepoints_positive": "ko_codepoint_count > 0 AND en_codepoint_count > 0", "domain_present": "domain IS NOT NULL"}


@query("SELECT rule, n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {p}) AS n {COHORT_FROM}" for k, p in READY.items()) + ")")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.counts_of(cohort(spark, sf_dir), {k: F.expr(p) for k, p in READY.items()})


@query("SELECT a, b, \"both\", a = b AND a = \"both\" AS equivalent FROM (SELECT count(*) FILTER (WHERE exact_duplicate_flag) AS a, count(*) FILTER (WHERE duplicate_disposition = 'NON_REPRESENTATIVE_DUPLICATE') AS b, count(*) FILTER (WHERE exact_duplicate_flag AND duplicate_disposition = 'NON_REPRESENTATIVE_DUPLICATE') AS \"both\" FROM pair_registry)")
def biconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.biconditional(table(spark, sf_dir, "pair_registry"), F.col("exact_duplicate_flag"), F.col("duplicate_disposition") == "NON_REPRESENTATIVE_DUPLICATE")


@query("SELECT 'exact' AS pair, count(*) FILTER (WHERE ko_grapheme_count <> ko_codepoint_count) AS differing FROM rep_features UNION ALL SELECT 'space_runs', count(*) FILTER (WHERE ko_space_run_count <> ko_whitespace_count) FROM rep_features")
def equality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rep_features")
    return ag.counts_of(d, {"exact": F.col("ko_grapheme_count") != F.col("ko_codepoint_count"), "space_runs": F.col("ko_space_run_count") != F.col("ko_whitespace_count")}, "pair").withColumnRenamed("n", "differing")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def fact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain large equi join with an aggregate on top."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))
