"""Queries of contracts and gates: rule catalogues, invariants, exact gates, orders, deferred columns, closed forms of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as mo
from ..functions import quality as ql
from ..functions import text as tx
from ..functions import tokenizer as tk
from ..operators import aggregate as ag
from ..operators import models as ml
from ..operators import protocols as pr
from ..operators import sampling as sm
from ..operators import validate as va
from ..session import cut, spread, table
from .registry import query
from .measure_queries import PLAIN_CHUNKS
from .relation_queries import COHORT_FROM, cohort

COUNTS = ("codepoint_count", "grapheme_count", "utf8_bytes", "whitespace_count", "space_run_count", "script_type_count", "script_switch_count")
SHARES = ("hangul_share", "latin_share", "digit_share", "punctuation_share", "symbol_other_share")
RATES = ("bytes_per_codepoint", "bytes_per_grapheme", "whitespace_density", *SHARES)
PAIRS = {"pair_codepoint_ratio": "codepoint_count", "pair_grapheme_ratio": "grapheme_count", "pair_byte_ratio": "utf8_bytes"}
PROVENANCE = ("feature_extractor_version", "unicode_version", "grapheme_implementation", "config_sha256", "measured_at")


def _catalogue() -> dict[str, tuple[str, str]]:
    """Rule, class and the condition that breaks it, in SQL that Spark and others read alike. A null breaks only the rule that asks for it."""
    infinite = lambda c: f"(isnan(CAST({c} AS DOUBLE)) OR abs(CAST({c} AS DOUBLE)) = CAST('Infinity' AS DOUBLE))"
    ratio = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    hard: dict[str, str] = {}
    by_definition: dict[str, str] = {}
    for s, words in (("ko", "eojeol_count"), ("en", "word_count")):
        at = {c: f"{s}_{c}" for c in (*COUNTS, *RATES)}
        hard |= {f"{s}_{c}_positive": f"{at[c]} <= 0" for c in COUNTS[:3]}
        hard |= {f"{s}_{c}_not_negative": f"{s}_{c} < 0" for c in (*COUNTS[3:], *RATES, words)}
        hard |= {f"{s}_{c}_finite": infinite(f"{s}_{c}") for c in (*COUNTS, *RATES, words)}
        hard |= {f"{s}_{c}_at_most_one": f"{at[c]} > 1" for c in (*SHARES, "whitespace_density")}
        hard |= {f"{s}_{c}_boolean": f"CAST({s}_{c} AS INT) NOT IN (0, 1)" for c in ("url_flag", "email_flag", "emoji_flag", "code_like_flag")}
        at_most = {"grapheme_count": "codepoint_count", "codepoint_count": "utf8_bytes", "whitespace_count": "codepoint_count", "space_run_count": "whitespace_count"}
        hard |= {f"{s}_{a}_at_most_{b}": f"{at[a]} > {at[b]}" for a, b in at_most.items()}
        hard |= {f"{s}_bytes_per_codepoint_one_to_four": f"{at['bytes_per_codepoint']} < 1 OR {at['bytes_per_codepoint']} > 4", f"{s}_bytes_per_grapheme_at_least_one": f"{at['bytes_per_grapheme']} < 1"}
        hard[f"{s}_words_at_most_gaps_and_one"] = f"{s}_{words} > {at['space_run_count']} + 1"
        by_definition |= {
            f"{s}_shares_close": f"abs({' + '.join(at[c] for c in SHARES)} + {at['whitespace_density']} - 1) > 1e-9",
            f"{s}_script_types_counted": f"{at['script_type_count']} <> " + " + ".join(f"CAST({at[c]} > 0 AS INT)" for c in ("hangul_share", "latin_share", "symbol_other_share")),
            f"{s}_switches_need_two_types": f"{at['script_switch_count']} > 0 AND {at['script_type_count']} < 2",
            f"{s}_bytes_per_codepoint_defined": f"abs({at['bytes_per_codepoint']} - {ratio(at['utf8_bytes'], at['codepoint_count'])}) > 1e-12",
            f"{s}_bytes_per_grapheme_defined": f"abs({at['bytes_per_grapheme']} - {ratio(at['utf8_bytes'], at['grapheme_count'])}) > 1e-12",
            f"{s}_whitespace_density_defined": f"abs({at['whitespace_density']} - {ratio(at['whitespace_count'], at['codepoint_count'])}) > 1e-12",
        }
    for c, n in PAIRS.items():
        hard[f"{c}_finite_and_positive"] = f"{infinite(c)} OR {c} <= 0"
        by_definition[f"{c}_defined"] = f"abs({c} - {ratio(f'ko_{n}', f'en_{n}')}) > 1e-12"
    by_definition["pair_codepoint_diff_defined"] = "pair_codepoint_diff <> ko_codepoint_count - en_codepoint_count"
    hard["provenance_is_there"] = " OR ".join(f"{c} IS NULL" for c in PROVENANCE)
    return {k: ("HARD", v) for k, v in hard.items()} | {k: ("DEFINITIONAL", v) for k, v in by_definition.items()}


CATALOGUE = _catalogue()


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, '{kind}' AS class, count(*) FILTER (WHERE {p}) AS n, round(count(*) FILTER (WHERE {p}) / nullif(count(*), 0), 9) AS rate FROM rep_features" for k, (kind, p) in CATALOGUE.items()))
def feature_rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All validity and definition rules of the surface features, counted in one scan."""
    d = table(spark, sf_dir, "rep_features")
    kinds = F.create_map(*(F.lit(x) for k, (kind, _) in CATALOGUE.items() for x in (k, kind)))
    counts = ag.counts_of(d, {"": F.lit(True)} | {k: F.expr(p) for k, (_, p) in CATALOGUE.items()})
    total = counts.where("rule = ''").select(F.col("n").alias("_t"))
    return counts.where("rule <> ''").join(total, F.lit(True)).select("rule", F.try_element_at(kinds, "rule").alias("class"), "n", F.round(F.col("n") / F.nullif(F.col("_t"), F.lit(0)), 9).alias("rate"))


SIDES = ("ko", "en")
CHUNK_SQL = """SELECT pair_id, ko_text_analysis AS ko_text, en_text_analysis AS en_text, """ + ", ".join(rf"regexp_extract_all({s}_text_analysis, ' ?\p{{L}}+| ?\p{{N}}+| ?[^ \t\n\f\r\p{{L}}\p{{N}}]+|[ \t\n\f\r]+') AS {s}" for s in SIDES) + " FROM pair_registry"
CHUNK_RULES = {
    "no_chunks": "len({s}) = 0", "bytes_not_those_of_the_text": "coalesce(list_sum(list_transform({s}, lambda x: octet_length(encode(x)))), 0) <> octet_length(encode({s}_text))", "not_the_text": "array_to_string({s}, '') <> {s}_text",
    "median_above_p90": "false", "p90_above_greatest": "false", "mean_not_defined": "false", "shares_not_one": "false",
}


@query(" UNION ALL ".join(f"SELECT '{s}' AS side, '{k}' AS rule, count(*) FILTER (WHERE {p.format(s=s)}) AS n FROM ({CHUNK_SQL})" for s in SIDES for k, p in CHUNK_RULES.items()) + " UNION ALL SELECT 'pair', 'repeated_ids', count(*) - count(DISTINCT pair_id) FROM pair_registry")
def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each text's chunks and their statistics: those that must never break are 0 on any data."""
    d = table(spark, sf_dir, "pair_registry").select("pair_id", *(x for s in SIDES for x in (F.col(f"{s}_text_analysis").alias(f"{s}_text"), tk.chunks(f"{s}_text_analysis", PLAIN_CHUNKS).alias(s))))
    rules = {}
    for s in SIDES:
        c = tk.chunk_statistics(s)
        n = F.col(s)
        kinds = sum((c[f"chunk_type_share_{k}"] for k in tk.CHUNK_KINDS[1:]), c[f"chunk_type_share_{tk.CHUNK_KINDS[0]}"])
        rules |= {
            (s, "no_chunks"): c["chunk_count"] == 0, (s, "bytes_not_those_of_the_text"): c["chunk_byte_total"] != F.octet_length(f"{s}_text"), (s, "not_the_text"): F.array_join(n, "") != F.col(f"{s}_text"),
            (s, "median_above_p90"): c["p50_chunk_bytes"] > F.greatest(c["p90_chunk_bytes"], c["p50_chunk_bytes"]), (s, "p90_above_greatest"): c["p90_chunk_bytes"] > c["max_chunk_bytes"],
            (s, "mean_not_defined"): F.abs(c["mean_chunk_bytes"] - c["chunk_byte_total"] / F.nullif(c["chunk_count"], F.lit(0))) > 1e-12, (s, "shares_not_one"): F.abs(kinds - 1) > 1e-9,
        }
    counts = ag.counts_of(d, {"|".join(k): p for k, p in rules.items()}).select(F.split_part("rule", F.lit("|"), F.lit(1)).alias("side"), F.split_part("rule", F.lit("|"), F.lit(2)).alias("rule"), "n")
    return counts.unionByName(d.agg(F.lit("pair").alias("side"), F.lit("repeated_ids").alias("rule"), (F.count("*") - F.count_distinct("pair_id")).alias("n")))


TOKEN_RULES = ("chunks_do_not_tile", "chunk_tokens_are_not_the_text_s", "total_is_not_the_encoding_s", "greatest_above_total")


@query("SELECT unnest([" + ", ".join(f"'{s}_{r}'" for s in SIDES for r in TOKEN_RULES) + "]) AS rule, 0::BIGINT AS n")
def chunk_token_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the tokenizer's own pattern against the encoding of the whole text: every rule must hold of every pair."""
    texts = {f"{s}_": f"{s}_text_analysis" for s in SIDES}
    d = tk.with_token_ids(tk.with_chunk_tokens(spread(table(spark, sf_dir, "pair_registry").select("pair_id", *texts.values())), texts), texts)
    rules = {}
    for s in SIDES:
        total = F.aggregate(f"{s}_chunk_tokens", F.lit(0), lambda a, b: a + b)
        rules |= dict(zip((f"{s}_{r}" for r in TOKEN_RULES), (~F.col(f"{s}_chunks_tile"), ~F.col(f"{s}_chunk_tokens_match"), total != F.size(f"{s}_token_ids"), F.array_max(f"{s}_chunk_tokens") > total), strict=True))
    return ag.counts_of(d, rules)


MORPH_FIELDS = ("morpheme_count", "particle_count", "ending_count", "deriv_affix_count", "morpheme_density", "particle_ratio", "ending_ratio", "deriv_affix_ratio", "function_morpheme_ratio", "analysis_warning_flag", "analysis_warning_reason")


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in ("(rows)", *MORPH_FIELDS)) + "]) AS field, 0::BIGINT AS differing")
def morph_scalar_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of exact equality: features by expressions against those computed one by one, field for field."""
    key = F.xxhash64("pair_id", "measured_at", F.to_json("morpheme_sequence"), "eojeol_count").alias("k")
    d = table(spark, sf_dir, "morph_features").select(key, F.coalesce("morpheme_sequence", F.array().cast(mo.SEQUENCE_TYPE)).alias("morpheme_sequence"), "eojeol_count").dropDuplicates(["k"])
    return va.differing_fields(d.select("k", *(c.alias(n) for n, c in mo.morph_features().items())), mo.with_scalar_features(d, "k"), "k")


@query('SELECT count(*) AS "rows", count(*) FILTER (WHERE ingest_batch < before) AS breaks FROM (SELECT ingest_batch, lag(ingest_batch) OVER (ORDER BY ingested_at NULLS FIRST, pair_id) AS before FROM pair_registry)')
def order_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrived after one of a later batch."""
    return va.order_breaks(table(spark, sf_dir, "pair_registry"), ["ingested_at", "pair_id"], "ingest_batch")


@query("SELECT domain, pair_id FROM (SELECT domain, pair_id, row_number() OVER (PARTITION BY domain ORDER BY md5(pair_id || 'reservoir-7'), pair_id) AS k FROM pair_registry) WHERE k <= 25")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.reservoir(table(spark, sf_dir, "pair_registry").select("domain", "pair_id"), "pair_id", 25, 7, ["domain"])


@query("SELECT pair_id, NULL::BOOLEAN AS translation_quality_review_flag, NULL::BOOLEAN AS named_entity_heavy_flag, 'DEFERRED' AS named_entity_evaluation_status FROM pair_registry")
def deferred_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pair_registry").select("pair_id", *(c.alias(k) for k, c in ql.deferred().items()))


@query(
    """WITH f AS (SELECT translation_direction_raw AS expected, json_extract_string(raw_metadata_json, '$.source_language') AS s, json_extract_string(raw_metadata_json, '$.target_language') AS t,
  coalesce(json_extract_string(raw_metadata_json, '$.ko_original'), '') <> '' AS k, coalesce(json_extract_string(raw_metadata_json, '$.en_original'), '') <> '' AS e FROM pair_registry),
d AS (SELECT *, CASE WHEN s = 'ko' AND t = 'en' THEN 'KO_TO_EN' WHEN s = 'en' AND t = 'ko' THEN 'EN_TO_KO' END AS l, CASE WHEN k AND NOT e THEN 'KO_TO_EN' WHEN e AND NOT k THEN 'EN_TO_KO' END AS o FROM f),
r AS (SELECT expected, CASE WHEN l = expected AND (o = expected OR o IS NULL) THEN expected ELSE 'UNKNOWN' END AS resolved, NOT coalesce(l = expected AND o = expected, false) AS review FROM d)
SELECT expected, resolved, review, count(*) AS n FROM r GROUP BY ALL"""
)
def direction_from_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    found = ql.direction(F.from_json("raw_metadata_json", "map<string,string>"), F.col("translation_direction_raw"))
    return d.select(F.col("translation_direction_raw").alias("expected"), found["translation_direction_raw"].alias("resolved"), found["translation_direction_review_flag"].alias("review")).groupBy("expected", "resolved", "review").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT coalesce(ko_text_analysis = '' OR en_text_analysis = '', false) AS e, coalesce(contains(ko_text_analysis, chr(65533)) OR contains(en_text_analysis, chr(65533)), false) AS d FROM pair_registry)
SELECT CASE WHEN e THEN 'empty_text_flag' WHEN d THEN 'decode_integrity_flag' ELSE 'accepted' END AS status, count(*) AS n, count(*) FILTER (WHERE e) AS empty_text_flag, count(*) FILTER (WHERE d) AS decode_integrity_flag FROM f GROUP BY status"""
)
def pluggable_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's summary of a run whose flags, status and summary are plugged in."""
    computer = pr.SideFlags(names={"empty_text_flag": "empty", "decode_integrity_flag": "decode"})
    return pr.run(table(spark, sf_dir, "pair_registry"), computer, pr.FirstFlag(), pr.FlagCounts())[1]


FAMILIES = {
    "size": ["ko_codepoint_count", "en_codepoint_count", "ko_eojeol_count"], "whitespace": ["ko_whitespace_density", "en_whitespace_density"], "digits": ["ko_digit_share", "en_digit_share"],
    "script": ["ko_latin_share", "ko_script_switch_count"], "premium": ["log_token_premium", "log_compression_penalty", "log_byte_density_ratio"], "morphology": ["morpheme_density", "particle_ratio", "ending_ratio", "deriv_affix_ratio"],
}
COLUMNS = list(dict.fromkeys(c for f in FAMILIES.values() for c in f))
FAMILY_PAIRS = [(k, a, b) for k, f in FAMILIES.items() for i, a in enumerate(f) for b in f[i + 1 :]]


@query(
    "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLUMNS) + f" {COHORT_FROM}) "
    + " UNION ALL ".join(f"SELECT '{k}' AS family, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS rho, abs(corr({a}, {b})) >= 0.95 AS triggered FROM r" for k, a, b in FAMILY_PAIRS)
)
def spearman_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations among the columns of each construct; 0.95 calls for a review."""
    d = ag.rank_correlations(cut(cohort(spark, sf_dir).select(*COLUMNS)), FAMILIES)
    return d.select("family", "a", "b", F.round("rho", 9).alias("rho"), (F.abs("rho") >= 0.95).alias("triggered"))


TWO = """WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_tax AS b FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_tax IS NOT NULL),
m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb, regr_sxx(y, y) AS yy, regr_sxy(a, b) AS ab, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS yb FROM d),
f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m),
g AS (SELECT *, (ba * ay + b2 * yb) / yy AS full_r2, ay * ay / (aa * yy) AS reduced_r2, ab * ab / (aa * bb) AS r12 FROM f)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ml.Gram, ml.Fit]:
    d = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_tax")
    g = ml.gram(d, ["l_quantity", "l_tax"], ["l_extendedprice"])
    return d, g, ml.ols(g, "l_extendedprice")


@query(
    TWO + """, e AS (SELECT (y - my - ba * (a - ma) - b2 * (b - mb)) AS e, a - ma AS u, b - mb AS v FROM d, g), s AS (SELECT sum(e * e * u * u) AS uu, sum(e * e * u * v) AS uv, sum(e * e * v * v) AS vv FROM e)
SELECT round(ba, 4) AS beta_quantity, round(b2, 2) AS beta_tax, round(full_r2, 9) AS r2, round(full_r2 - reduced_r2, 9) AS delta_r2, round(1 - (1 - full_r2) / (1 - reduced_r2), 9) AS partial_r2, round(n * ln((1 - reduced_r2) / (1 - full_r2)), 4) AS lr_chi2,
  round(b2 * b2 / ((ab * ab * uu - 2 * aa * ab * uv + aa * aa * vv) / ((aa * bb - ab * ab) ** 2) * n / (n - 3)), 4) AS wald_chi2, 1 AS df FROM g, s"""
)
def nested_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second regressor's part in a model, by every measure, against closed forms."""
    d, g, fit = _two(spark, sf_dir)
    n, w = ml.nested(fit, ml.ols(g, "l_extendedprice", ["l_quantity"])), ml.wald(d, fit, ["l_tax"])
    row = (round(float(fit.beta[1]), 4), round(float(fit.beta[2]), 2), round(fit.r2, 9), round(n["delta_r2"], 9), round(n["partial_r2"], 9), round(n["lr_chi2"], 4), round(w["wald_chi2"], 4), w["df"])
    return spark.createDataFrame([row], "beta_quantity double, beta_tax double, r2 double, delta_r2 double, partial_r2 double, lr_chi2 double, wald_chi2 double, df int")


@query(
    TWO + """ SELECT unnest(['max_vif', 'condition', 'gvif:both', 'pc1_share']) AS what, round(unnest([1 / (1 - r12), sqrt((1 + sqrt(r12)) / (1 - sqrt(r12))), 1.0, (1 + sqrt(r12)) / 2]), 9) AS value FROM g"""
)
def collinearity_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation, condition and components of two columns: all follow from their correlation."""
    _, g, _ = _two(spark, sf_dir)
    rows = [(r["what"], round(r["value"], 9)) for r in ml.triggers(g, {"both": ["l_quantity", "l_tax"]})]
    return spark.createDataFrame([*rows, ("pc1_share", round(ml.principal_components(g, 1)["share"][0], 9))], "what string, value double")


SUBSETS = {"all": "true", "returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "small": "l_quantity < 10", "untaxed": "l_tax = 0", "not_returned": "l_returnflag <> 'R'"}
VARIANTS = {"quantity": "l_quantity", "tax": "l_tax"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS subset, '{v}' AS variant, count(*) AS n, CASE WHEN var_pop({c}) > 0 THEN round(regr_slope(l_extendedprice, {c}), 3) END AS slope, CASE WHEN var_pop({c}) > 0 THEN round(regr_r2(l_extendedprice, {c}), 9) END AS r2 FROM lineitem WHERE {p} AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_tax IS NOT NULL" for k, p in SUBSETS.items() for v, c in VARIANTS.items()))
def subset_variant_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row subsets by column variants: products of all subsets in one pass, each model a part of them. A column constant in its subset has no slope."""
    d = table(spark, sf_dir, "lineitem")
    grams = ml.subset_grams(d, list(VARIANTS.values()), ["l_extendedprice"], {k: F.expr(p) for k, p in SUBSETS.items()})
    rows = []
    for k, g in grams.items():
        for v, c in VARIANTS.items():
            fit = ml.ols(g, "l_extendedprice", [c])
            known = len(fit.beta) > 1
            rows.append((k, v, int(fit.n), round(float(fit.beta[1]), 3) if known else None, round(fit.r2, 9) if known else None))
    return spark.createDataFrame(rows, "subset string, variant string, n long, slope double, r2 double")


@query()
def block_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks of columns add to the full model: R-squared gain with its bootstrap interval, and the robust Wald test."""
    import numpy as np

    from .inference_queries import _matrix

    d, x = _matrix(spark, sf_dir)
    g = ml.gram(d, x, ["log_token_premium"])
    fit = ml.ols(g, "log_token_premium")
    blocks = {"scripts": ["ko_latin_share", "ko_digit_share"], "morphology": ["morpheme_density", "particle_ratio"], "domain": [c for c in fit.terms if c.startswith("domain=")]}
    draws = ml.bootstrap_gain(d, g, fit, blocks, "pair_id", 200, 20260818)
    rows = []
    for k, own in blocks.items():
        own = [c for c in own if c in fit.terms]
        n, w = ml.nested(fit, ml.ols(g, "log_token_premium", [c for c in x if c not in own])), ml.wald(d, fit, own)
        low, high = np.percentile(draws[k], [2.5, 97.5])
        rows.append((k, n["delta_r2"], float(low), float(high), n["partial_r2"], w["wald_chi2"], w["df"]))
    return spark.createDataFrame(rows, "block string, delta_r2 double, low double, high double, partial_r2 double, wald_chi2 double, df int")


EDGE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("SELECT pair_id, " + ", ".join(f"regexp_replace(regexp_replace(nfc_normalize({s}_text_raw), '^﻿+|﻿+$', '', 'g'), '^{EDGE}+|{EDGE}+$', '', 'g') AS {s}_analysis" for s in SIDES) + " FROM pair_registry")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pair_registry").select("pair_id", *(tx.analysis_text(f"{s}_text_raw").alias(f"{s}_analysis") for s in SIDES))


@query(f"WITH s AS (SELECT ko_codepoint_count::DOUBLE AS x, token_premium AS y, md5(pair_id || 'ranks') AS h, pair_id {COHORT_FROM} ORDER BY h, pair_id LIMIT 1000), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s) SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r")
def spearman_of_a_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation on a reproducible sample (the feature)."""
    d = sm.hash_sample(cohort(spark, sf_dir).select("pair_id", "ko_codepoint_count", "token_premium"), "pair_id", 1000, "ranks")
    return ag.spearman(d, "ko_codepoint_count", "token_premium").withColumn("rho", F.round("rho", 9))


@query(
    """WITH r AS (SELECT raw_metadata_json::JSON AS j FROM pair_registry WHERE json_valid(raw_metadata_json) AND json_type(raw_metadata_json) = 'OBJECT'), k AS (SELECT j, unnest(json_keys(j)) AS field FROM r),
t AS (SELECT field, json_type(j, '$."' || field || '"') AS t, json_extract_string(j, '$."' || field || '"') AS s FROM k)
SELECT field, (SELECT count(*) FROM r) - count(*) AS absent, count(*) FILTER (WHERE t = 'NULL') AS nulls, count(*) FILTER (WHERE t = 'VARCHAR' AND s = '') AS "empty", count(*) FILTER (WHERE t = 'VARCHAR') AS strings, count(*) FILTER (WHERE t IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS numbers,
  count(*) FILTER (WHERE t = 'BOOLEAN') AS booleans, count(*) FILTER (WHERE t = 'ARRAY') AS arrays, count(*) FILTER (WHERE t = 'OBJECT') AS objects, count(DISTINCT s) FILTER (WHERE t NOT IN ('ARRAY', 'OBJECT', 'NULL')) AS distinct_values FROM t GROUP BY field"""
)
def metadata_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the raw records: absent, null and empty told apart, and their types."""
    return ag.json_profile(table(spark, sf_dir, "pair_registry"), "raw_metadata_json")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_slope(l_extendedprice - 1000 * l_quantity, l_quantity), 4) AS shifted_slope, round(regr_slope(l_extendedprice, l_quantity) - regr_slope(l_extendedprice - 1000 * l_quantity, l_quantity), 4) AS shift, true AS same_residuals FROM lineitem")
def outcome_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome less a multiple of a column: its coefficient shifts by the multiple, all else, the residuals too, stays."""
    d = table(spark, sf_dir, "lineitem").withColumn("shifted", F.col("l_extendedprice") - 1000 * F.col("l_quantity"))
    g = ml.gram(d, ["l_quantity"], ["l_extendedprice", "shifted"])
    a, b = (ml.ols(g, y) for y in ("l_extendedprice", "shifted"))
    row = (round(float(a.beta[1]), 4), round(float(b.beta[1]), 4), round(float(a.beta[1] - b.beta[1]), 4), bool(abs(a.ssr - b.ssr) <= 1e-9 * a.ssr))
    return spark.createDataFrame([row], "slope double, shifted_slope double, shift double, same_residuals boolean")


@query(
    "SELECT side, flag, n FROM (" + " UNION ALL ".join(
        f"SELECT '{s}' AS side, '{k}' AS flag, count(*) FILTER (WHERE {p.replace('@', f'{s}_text_raw')}) AS n FROM pair_registry" for s in SIDES for k, p in {"empty": f"regexp_matches(@, '^{EDGE}*$')", "leading_or_trailing_whitespace": f"regexp_matches(@, '^{EDGE}|{EDGE}$')"}.items()) + ")"
)
def raw_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    flags = {f"{s}|{k}": tx.noise_flags(f"{s}_text_raw", s)[k] for s in SIDES for k in ("empty", "leading_or_trailing_whitespace")}
    return ag.counts_of(d, flags, "f").select(F.split_part("f", F.lit("|"), F.lit(1)).alias("side"), F.split_part("f", F.lit("|"), F.lit(2)).alias("flag"), "n")


@query(
    """SELECT pair_id, true AS roundtrip_ok, round(nullif(length(ko_text_analysis), 0) / nullif(length(en_text_analysis), 0), 9) AS code_point_ratio,
  round((octet_length(encode(ko_text_analysis)) / nullif(length(ko_text_analysis), 0)) / nullif(octet_length(encode(en_text_analysis)) / nullif(length(en_text_analysis), 0), 0), 9) AS byte_density_ratio,
  CASE WHEN ko_text_analysis <> '' AND en_text_analysis <> '' THEN true END AS factors_multiply, true AS tokens_at_most_bytes FROM pair_registry"""
)
def encoded_pair_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every pair's encoding: it can be decoded, tokens are at most bytes, and the premium is the product of its factors."""
    d = spread(table(spark, sf_dir, "pair_registry").select("pair_id", "ko_text_analysis", "en_text_analysis"))
    d = tk.with_token_ids(d, {f"{s}_": f"{s}_text_analysis" for s in SIDES})
    d = d.select("pair_id", (F.col("ko_roundtrip_ok") & F.col("en_roundtrip_ok")).alias("roundtrip_ok"), *(c for s in SIDES for c in (F.size(f"{s}_token_ids").alias(f"{s}_tokens"), F.length(f"{s}_text_analysis").alias(f"{s}_codepoints"), F.octet_length(f"{s}_text_analysis").alias(f"{s}_bytes"))))
    x = tk.decomposition()
    fits = F.expr("ko_tokens <= ko_bytes and en_tokens <= en_bytes")
    return d.select("pair_id", "roundtrip_ok", F.round(x["code_point_ratio"], 9).alias("code_point_ratio"), F.round(x["byte_density_ratio"], 9).alias("byte_density_ratio"), (x["identity_abs_error"] < 1e-9).alias("factors_multiply"), fits.alias("tokens_at_most_bytes"))
