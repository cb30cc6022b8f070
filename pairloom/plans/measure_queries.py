"""Queries over morphemes, tokens and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as mo
from ..functions import tokenizer as tk
from ..operators import aggregate as ag
from ..operators import ranks as rk
from ..operators.relations import latest_rows
from ..session import spread, table
from .registry import query


def _latest_morphs(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "morph_features"), "pair_id", "measured_at", ["morpheme_count", "morpheme_density"], columns)


def latest_tokens(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "token_measurement"), "pair_id", "measured_at", ["ko_token_count", "en_token_count"], columns)


TOKENS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC NULLS LAST, ko_token_count DESC NULLS LAST, en_token_count DESC NULLS LAST) AS k FROM token_measurement WHERE pair_id IS NOT NULL) WHERE k = 1"
MORPHS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC NULLS LAST, morpheme_count DESC NULLS LAST, morpheme_density DESC NULLS LAST) AS k FROM morph_features WHERE pair_id IS NOT NULL) WHERE k = 1"


@query(
    """WITH c AS (SELECT morph_measurement_id, eojeol_count AS e, len(morpheme_sequence) AS n,
  len(list_filter(morpheme_sequence, lambda m: starts_with(m.pos, 'J'))) AS p, len(list_filter(morpheme_sequence, lambda m: starts_with(m.pos, 'E'))) AS g,
  len(list_filter(morpheme_sequence, lambda m: split_part(m.pos, '-', 1) IN ('XSN', 'XSV', 'XSA'))) AS x FROM morph_features)
SELECT morph_measurement_id, n AS morpheme_count, p AS particle_count, g AS ending_count, x AS deriv_affix_count, round(n / nullif(e, 0), 9) AS morpheme_density,
  round(p / nullif(n, 0), 9) AS particle_ratio, round(g / nullif(n, 0), 9) AS ending_ratio, round(x / nullif(n, 0), 9) AS deriv_affix_ratio, round((p + g) / nullif(n, 0), 9) AS function_morpheme_ratio, n = 0 AS analysis_warning_flag FROM c"""
)
def morph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mo.morph_features()
    return table(spark, sf_dir, "morph_features").select("morph_measurement_id", *((F.round(c, 9) if k.endswith(("ratio", "density")) else c).alias(k) for k, c in f.items() if k != "analysis_warning_reason"))


@query("SELECT split_part(m.pos, '-', 1) AS tag, count(*) AS n, count(*) FILTER (WHERE contains(m.pos, '-')) AS irregular FROM (SELECT unnest(morpheme_sequence) AS m FROM morph_features) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "morph_features").select(F.explode("morpheme_sequence").alias("m"))
    return m.groupBy(mo.base_tag(F.col("m.pos")).alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.contains(F.col("m.pos"), F.lit("-"))).alias("irregular"))


@query("SELECT form, pos, count(*) AS n FROM (SELECT unnest(morpheme_sequence, recursive := true) FROM morph_features) GROUP BY form, pos ORDER BY n DESC, form, pos LIMIT 25")
def commonest_morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "morph_features").select(F.inline("morpheme_sequence"))
    return m.groupBy("form", "pos").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form", "pos").limit(25)


@query("SELECT analysis_warning_reason, count(*) AS n, count(*) FILTER (WHERE morpheme_count <> len(morpheme_sequence)) AS count_mismatch, count(*) FILTER (WHERE abs(morpheme_density - morpheme_count / nullif(eojeol_count, 0)) > 1e-9) AS density_mismatch FROM morph_features GROUP BY ALL")
def morph_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("morpheme_density") - F.col("morpheme_count") / F.nullif(F.col("eojeol_count"), F.lit(0))) > 1e-9
    # Of NaN and a number SQL says it is greater than any number, as Spark does.
    return table(spark, sf_dir, "morph_features").groupBy("analysis_warning_reason").agg(F.count("*").alias("n"), F.count_if(F.col("morpheme_count") != F.size("morpheme_sequence")).alias("count_mismatch"), F.count_if(off).alias("density_mismatch"))


@query(
    """WITH r AS (SELECT pair_id, morpheme_count AS c, particle_count AS p, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at, morpheme_count) AS a, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC, morpheme_count DESC) AS z FROM morph_features)
SELECT count(*) AS pairs, count(*) FILTER (WHERE n.c <> o.c) AS count_changed, count(*) FILTER (WHERE n.p <> o.p) AS particle_changed, sum(n.c - o.c)::BIGINT AS total_change
FROM (SELECT * FROM r WHERE a = 1) o JOIN (SELECT * FROM r WHERE z = 1) n USING (pair_id)"""
)
def remeasurement_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against latest measurement of each pair."""
    m = table(spark, sf_dir, "morph_features")
    at, now = F.struct("measured_at", "morpheme_count"), F.struct("morpheme_count", F.col("particle_count"))
    d = m.groupBy("pair_id").agg(F.min_by(now, at).alias("o"), F.max_by(now, at).alias("n"))
    return d.agg(F.count("*").alias("pairs"), F.count_if(F.col("n.morpheme_count") != F.col("o.morpheme_count")).alias("count_changed"), F.count_if(F.col("n.particle_count") != F.col("o.particle_count")).alias("particle_changed"), F.sum(F.col("n.morpheme_count") - F.col("o.morpheme_count")).alias("total_change"))


@query(
    f"""SELECT pair_id, tk - te AS token_difference, round(tk / te, 9) AS token_premium, round(ln(tk / te), 9) AS log_token_premium, round(ck / ce, 9) AS code_point_ratio,
  round((bk / ck) / (be / ce), 9) AS byte_density_ratio, round((tk / bk) / (te / be), 9) AS compression_penalty FROM (
  SELECT pair_id, nullif(len(ko_token_ids), 0)::DOUBLE AS tk, nullif(len(en_token_ids), 0)::DOUBLE AS te, nullif(length(ko_text_analysis), 0)::DOUBLE AS ck, nullif(length(en_text_analysis), 0)::DOUBLE AS ce,
    nullif(octet_length(encode(ko_text_analysis)), 0)::DOUBLE AS bk, nullif(octet_length(encode(en_text_analysis)), 0)::DOUBLE AS be FROM ({TOKENS}) JOIN pair_registry USING (pair_id)) WHERE tk IS NOT NULL AND te IS NOT NULL"""
)
def token_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["ko_token_ids", "en_token_ids"])
    size = lambda s: F.when(F.size(f"{s}_token_ids") > 0, F.size(f"{s}_token_ids")).cast("double").alias(f"{s}_tokens")
    t = t.select("pair_id", size("ko"), size("en")).where("ko_tokens is not null and en_tokens is not null")
    texts = table(spark, sf_dir, "pair_registry").select("pair_id", *(f(f"{s}_text_analysis").alias(f"{s}_{n}") for s in ("ko", "en") for n, f in (("codepoints", F.length), ("bytes", F.octet_length))))
    d, f = t.join(texts, "pair_id"), tk.decomposition()
    return d.select("pair_id", f["token_difference"].alias("token_difference"), *(F.round(f[k], 9).alias(k) for k in ("token_premium", "log_token_premium", "code_point_ratio", "byte_density_ratio", "compression_penalty")))


INVARIANTS = {
    "ko_count_not_positive": "ko_token_count <= 0", "en_count_not_positive": "en_token_count <= 0", "difference_wrong": "token_difference <> ko_token_count - en_token_count",
    "premium_wrong": "abs(token_premium - ko_token_count * 1.0D / en_token_count) > 1e-9D", "log_wrong": "abs(log_token_premium - ln(token_premium)) > 1e-9D",
    "roundtrip_failed": "NOT roundtrip_ok", "identity_too_large": "identity_abs_error > 1e-10D",
    "identity_wrong": "abs(log_token_premium - (log_code_point_ratio + log_byte_density_ratio + log_compression_penalty)) > 1e-9D",
}


@query(
    "SELECT rule, n FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {p.replace('1.0D', '1.0::DOUBLE').replace('-9D', '-9').replace('-10D', '-10')}) AS n FROM token_measurement" for k, p in INVARIANTS.items())
    + " UNION ALL SELECT 'ko_length_wrong', count(*) FILTER (WHERE len(ko_token_ids) <> ko_token_count) FROM token_measurement UNION ALL SELECT 'en_length_wrong', count(*) FILTER (WHERE len(en_token_ids) <> en_token_count) FROM token_measurement)"
)
def token_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {k: F.expr(p) for k, p in INVARIANTS.items()} | {f"{s}_length_wrong": F.size(f"{s}_token_ids") != F.col(f"{s}_token_count") for s in ("ko", "en")}
    return ag.counts_of(table(spark, sf_dir, "token_measurement"), rules)


@query("SELECT greatest(max(list_max(ko_token_ids)), max(list_max(en_token_ids))) AS max_token_id, min(least(list_min(ko_token_ids), list_min(en_token_ids))) AS min_token_id FROM token_measurement")
def token_id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.coalesce("ko_token_ids", F.array().cast("array<int>")), F.coalesce("en_token_ids", F.array().cast("array<int>")))
    return table(spark, sf_dir, "token_measurement").agg(F.max(F.array_max(both)).alias("max_token_id"), F.min(F.array_min(both)).alias("min_token_id"))


@query()
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides under the offline vocabulary: token counts, round trip, and the exact decomposition."""
    d = spread(table(spark, sf_dir, "pair_registry").select("pair_id", "ko_text_analysis", "en_text_analysis"))
    d = tk.with_token_ids(d, {"ko_": "ko_text_analysis", "en_": "en_text_analysis"})
    d = d.select("pair_id", (F.col("ko_roundtrip_ok") & F.col("en_roundtrip_ok")).alias("roundtrip_ok"), *(c for s in ("ko", "en") for c in (F.size(f"{s}_token_ids").alias(f"{s}_tokens"), F.length(f"{s}_text_analysis").alias(f"{s}_codepoints"), F.octet_length(f"{s}_text_analysis").alias(f"{s}_bytes"))))
    return d.select("pair_id", "roundtrip_ok", "ko_tokens", "en_tokens", *(c.alias(k) for k, c in tk.decomposition().items()))


@query()
def chunk_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the tokenizer's pattern: do they tile the text, and are their tokens the whole text's?"""
    d = spread(table(spark, sf_dir, "pair_registry").select("pair_id", "ko_text_analysis", "en_text_analysis"))
    d = tk.with_chunk_tokens(d, {"ko_": "ko_text_analysis", "en_": "en_text_analysis"})
    return d.select(
        "pair_id", *(x.alias(n) for s in ("ko", "en") for n, x in (
            (f"{s}_chunk_count", F.size(f"{s}_chunks")), (f"{s}_token_total", F.aggregate(f"{s}_chunk_tokens", F.lit(0), lambda a, b: a + b)), (f"{s}_max_tokens_per_chunk", F.array_max(f"{s}_chunk_tokens")),
            (f"{s}_chunks_tile", F.col(f"{s}_chunks_tile")), (f"{s}_tokens_match", F.col(f"{s}_chunk_tokens_match")))),
    )


# A pattern without look-around, so that SQL engines know it too.
PLAIN_CHUNKS = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\f\r\p{L}\p{N}]+|[ \t\n\f\r]+"


@query(
    r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^ \t\n\f\r\p{L}\p{N}]+|[ \t\n\f\r]+') AS a, text FROM documents),
b AS (SELECT *, list_sort(list_transform(a, lambda x: octet_length(encode(x)))) AS z, len(a) AS n FROM c)
SELECT doc_id, n AS chunk_count, coalesce(list_sum(z), 0)::BIGINT AS chunk_byte_total, round(list_sum(z) / nullif(n, 0), 9) AS mean_chunk_bytes, round((z[(n + 1) // 2] + z[n // 2 + 1]) / 2.0, 9)::DOUBLE AS p50_chunk_bytes,
  z[greatest(1, least(n, ceil(n * 0.9::DOUBLE)::INT))]::DOUBLE AS p90_chunk_bytes, z[n] AS max_chunk_bytes, array_to_string(a, '') = text AS tiles,
  round(len(list_filter(a, lambda x: regexp_matches(x, '\p{L}'))) / nullif(n, 0), 9) AS chunk_type_share_letter,
  round(len(list_filter(a, lambda x: NOT regexp_matches(x, '\p{L}') AND regexp_matches(x, '\p{N}'))) / nullif(n, 0), 9) AS chunk_type_share_number FROM b"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tk.chunks("text", PLAIN_CHUNKS).alias("a"))
    s = tk.chunk_statistics("a")
    shown = ("mean_chunk_bytes", "p50_chunk_bytes", "p90_chunk_bytes", "chunk_type_share_letter", "chunk_type_share_number")
    return d.select("doc_id", s["chunk_count"].alias("chunk_count"), s["chunk_byte_total"].alias("chunk_byte_total"), s["max_chunk_bytes"].alias("max_chunk_bytes"), (F.array_join("a", "") == F.col("text")).alias("tiles"), *(F.round(s[k], 9).alias(k) for k in shown))


@query(
    f"""SELECT round(max(abs(t.log_token_premium - (log_code_point_ratio + log_byte_density_ratio + log_compression_penalty))), 9) AS additive_error, round(max(abs(token_premium - code_point_ratio * byte_density_ratio * compression_penalty)), 9) AS multiplicative_error,
  count(*) FILTER (WHERE identity_abs_error > 1e-10) AS violations, round(quantile_cont(identity_abs_error, 0.999), 12) AS p999 FROM ({TOKENS}) t"""
)
def decomposition_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["log_token_premium", "log_code_point_ratio", "log_byte_density_ratio", "log_compression_penalty", "token_premium", "code_point_ratio", "byte_density_ratio", "compression_penalty", "identity_abs_error"])
    add = F.abs(F.col("log_token_premium") - (F.col("log_code_point_ratio") + F.col("log_byte_density_ratio") + F.col("log_compression_penalty")))
    mul = F.abs(F.col("token_premium") - F.col("code_point_ratio") * F.col("byte_density_ratio") * F.col("compression_penalty"))
    sums = t.agg(F.round(F.max(add), 9).alias("additive_error"), F.round(F.max(mul), 9).alias("multiplicative_error"), F.count_if(F.col("identity_abs_error") > 1e-10).alias("violations"))
    return sums.join(rk.quantiles(t, "identity_abs_error", {"p999": 0.999}).select(F.round("p999", 12).alias("p999")), F.lit(True))


@query(f"SELECT round(avg(ln(ko_token_count)), 9) AS ko_mean_ln, round(avg(ln(en_token_count)), 9) AS en_mean_ln, round(avg(log_token_premium), 9) AS premium_mean, round(max(abs(log_token_premium - (ln(ko_token_count) - ln(en_token_count)))), 6) AS residual FROM ({TOKENS}) WHERE ko_token_count > 0 AND en_token_count > 0")
def log_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest_tokens(spark, sf_dir, ["ko_token_count", "en_token_count", "log_token_premium"]).where("ko_token_count > 0 and en_token_count > 0")
    return t.agg(F.round(F.avg(F.ln("ko_token_count")), 9).alias("ko_mean_ln"), F.round(F.avg(F.ln("en_token_count")), 9).alias("en_mean_ln"), F.round(F.avg("log_token_premium"), 9).alias("premium_mean"), F.round(F.max(F.abs(F.col("log_token_premium") - (F.ln("ko_token_count") - F.ln("en_token_count")))), 6).alias("residual"))
