"""Queries of quality control: flags, rejection, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as ql
from ..functions import text as tx
from ..operators import aggregate as ag
from ..operators import relations as rl
from ..session import table
from .registry import query


def _n(c: str, p: str) -> str:
    return f"length(regexp_replace({c}, '[^{p}]', '', 'g'))"


def _side(s: str) -> str:
    a, r = f"{s}_text_analysis", f"{s}_text_raw"
    control = f"({_n(a, r'\p{Cc}')} - {_n(a, r'\t\n')})"
    markup = r"</?[A-Za-z][^>]*>|https?://[^\t-\r ]+|www\.[^\t-\r ]+|[A-Za-z_][A-Za-z0-9_]*\([^)]*\)"
    share = lambda x, n: f"coalesce({x} / nullif({n}, 0), 0)"
    h, latin, alnum, n = _n(a, "가-힣"), _n(a, "A-Za-z"), _n(a, r"\p{L}\p{N}"), f"length({a})"
    own, other, name = (h, latin, "KO_NO_HANGUL_LATIN_DOMINANT") if s == "ko" else (latin, h, "EN_NO_LATIN_HANGUL_DOMINANT")
    zw = "​‌‍"
    return f"""{a} = '' AS {s}_empty, contains({a}, chr(65533)) AS {s}_decode,
    {share(f"coalesce(list_sum(list_transform(regexp_extract_all({a}, '{markup}'), lambda x: length(x))), 0)", n)} > 0.5 AS {s}_markup,
    ({control} + {_n(a, zw + chr(0xFEFF))}) / greatest({n}, 1) > 0.05 AS {s}_control,
    (contains(trim({r}, chr(65279)), chr(65279)) OR regexp_matches({r}, '[{zw}]') OR {control} > 0 OR regexp_matches({r}, '(^|\\s)\\p{{M}}')) AS {s}_unicode,
    {share(_n(a, r'\p{N}'), n)} > 0.20 AS {s}_digit, {share(_n(a, r'\p{P}'), n)} > 0.20 AS {s}_punct,
    ({share(h, alnum)} >= 0.10 AND {share(latin, alnum)} >= 0.10) AS {s}_mix,
    CASE WHEN {h} + {latin} < 5 THEN 'INSUFFICIENT_LINGUISTIC_EVIDENCE' WHEN {own} = 0 AND {other} >= 5 THEN '{name}' ELSE 'NONE' END AS {s}_reason"""


FLAGS = f"""SELECT pair_id, logical_corpus, duplicate_group_id, source_id, domain, translation_direction, {_side('ko')}, {_side('en')},
  ntile(5) OVER (ORDER BY length(en_text_analysis), pair_id) AS q,
  coalesce(min(pair_id) FILTER (logical_corpus IN ('025', '026')) OVER (PARTITION BY duplicate_group_id), min(pair_id) OVER (PARTITION BY duplicate_group_id)) AS rep FROM pair_registry"""
QC = f"""WITH f AS ({FLAGS}), h AS (SELECT *, ko_empty OR en_empty AS e, ko_decode OR en_decode AS d, ko_markup OR en_markup AS m, ko_control OR en_control AS c, pair_id <> rep AS x FROM f),
r AS (SELECT *, list_filter([CASE WHEN e THEN 'empty_text_flag' END, CASE WHEN d THEN 'decode_integrity_flag' END, CASE WHEN m THEN 'markup_dominant_flag' END,
  CASE WHEN c THEN 'control_char_excess_flag' END, CASE WHEN x THEN 'exact_duplicate_flag' END], lambda v: v IS NOT NULL) AS hard FROM h)"""


@query(
    QC
    + """ SELECT pair_id, e AS empty_text_flag, d AS decode_integrity_flag, m AS markup_dominant_flag, c AS control_char_excess_flag, x AS exact_duplicate_flag,
  ko_unicode OR en_unicode AS unicode_anomaly_flag, ko_digit OR en_digit AS high_digit_ratio_flag, ko_punct OR en_punct AS high_punctuation_ratio_flag, ko_mix OR en_mix AS script_mix_flag,
  ko_reason AS ko_lang_side_anomaly_reason, en_reason AS en_lang_side_anomaly_reason, ko_reason <> 'NONE' OR en_reason <> 'NONE' AS lang_side_anomaly_review_flag,
  hard[1] AS primary_rejection_reason, to_json(hard[2:])::VARCHAR AS secondary_rejection_flags, CASE WHEN len(hard) > 0 THEN 'rejected' ELSE 'accepted' END AS pair_quality_status,
  'Q' || q AS length_stratum, q = 1 AS short_text_flag, q = 5 AS long_text_flag, CASE WHEN x THEN 'NON_REPRESENTATIVE_DUPLICATE' ELSE 'REPRESENTATIVE' END AS duplicate_disposition FROM r"""
)
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ql.quality_columns(table(spark, sf_dir, "pair_registry"))
    return d.select(
        "pair_id", *ql.HARD_FLAGS, "unicode_anomaly_flag", "high_digit_ratio_flag", "high_punctuation_ratio_flag", "script_mix_flag", "ko_lang_side_anomaly_reason", "en_lang_side_anomaly_reason",
        "lang_side_anomaly_review_flag", "primary_rejection_reason", "secondary_rejection_flags", "pair_quality_status", "length_stratum", "short_text_flag", "long_text_flag", "duplicate_disposition",
    )


FLOW = {
    "raw_record_denominator": "true", "primary_eligible_denominator": "logical_corpus IN ('025', '026')",
    "final_analysis_denominator": "logical_corpus IN ('025', '026') AND analysis_eligible_exact_dedup AND pair_quality_status = 'accepted'",
    "accepted": "pair_quality_status = 'accepted'", "rejected": "pair_quality_status = 'rejected'", "empty_text_flag": "empty_text_flag", "decode_integrity_flag": "decode_integrity_flag",
    "markup_dominant_flag": "markup_dominant_flag", "control_char_excess_flag": "control_char_excess_flag", "exact_duplicate_flag": "duplicate_disposition = 'NON_REPRESENTATIVE_DUPLICATE'",
    "unicode_anomaly_flag": "unicode_anomaly_flag", "high_digit_ratio_flag": "high_digit_ratio_flag", "high_punctuation_ratio_flag": "high_punctuation_ratio_flag", "script_mix_flag": "script_mix_flag",
    "lang_side_anomaly_review_flag": "lang_side_anomaly_review_flag",
}


@query(
    "WITH t AS (SELECT count(*) AS denominator FROM pair_registry) SELECT metric, count, denominator, round(count / denominator, 12) AS rate FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER (WHERE {p}) AS count FROM pair_registry" for k, p in FLOW.items())
    + " UNION ALL SELECT 'exact_unique_content_denominator', count(DISTINCT duplicate_group_id) FROM pair_registry), t"
)
def qc_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    counts = ag.counts_of(d, {k: F.expr(p) for k, p in FLOW.items()}, "metric").withColumnRenamed("n", "count")
    unique = d.agg(F.count_distinct("duplicate_group_id").alias("count")).select(F.lit("exact_unique_content_denominator").alias("metric"), "count")
    total = d.agg(F.count("*").alias("denominator"))
    return counts.unionByName(unique).join(total, F.lit(True)).withColumn("rate", F.round(F.col("count") / F.col("denominator"), 12))


@query("SELECT 'KO' AS side, ko_lang_side_anomaly_reason AS reason, count(*) AS n FROM pair_registry GROUP BY ALL UNION ALL SELECT 'EN', en_lang_side_anomaly_reason, count(*) FROM pair_registry GROUP BY ALL")
def language_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.inline(F.array(*(F.struct(F.lit(s.upper()).alias("side"), F.col(f"{s}_lang_side_anomaly_reason").alias("reason")) for s in ("ko", "en"))))
    return table(spark, sf_dir, "pair_registry").select(sides).groupBy("side", "reason").agg(F.count("*").alias("n"))


@query("SELECT source_id, domain, translation_direction, length_stratum, count(*) AS eligible_count FROM pair_registry WHERE logical_corpus IN ('025', '026') AND analysis_eligible_exact_dedup AND pair_quality_status = 'accepted' GROUP BY ALL")
def sampling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").where("logical_corpus IN ('025', '026') AND analysis_eligible_exact_dedup AND pair_quality_status = 'accepted'")
    return d.groupBy("source_id", "domain", "translation_direction", "length_stratum").agg(F.count("*").alias("eligible_count"))


@query(
    QC
    + """ SELECT count(*) AS n, count(*) FILTER (WHERE p.empty_text_flag IS DISTINCT FROM e) AS empty_differs, count(*) FILTER (WHERE p.decode_integrity_flag IS DISTINCT FROM d) AS decode_differs,
  count(*) FILTER (WHERE p.pair_quality_status IS DISTINCT FROM CASE WHEN len(hard) > 0 THEN 'rejected' ELSE 'accepted' END) AS status_differs FROM r JOIN pair_registry p USING (pair_id)"""
)
def qc_against_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    new = ql.quality_columns(d).select("pair_id", *(F.col(c).alias(f"_{c}") for c in ("empty_text_flag", "decode_integrity_flag", "pair_quality_status")))
    j = d.join(new, "pair_id")
    off = lambda c: F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return j.agg(F.count("*").alias("n"), off("empty_text_flag").alias("empty_differs"), off("decode_integrity_flag").alias("decode_differs"), off("pair_quality_status").alias("status_differs"))


@query("SELECT pair_id, nfc_normalize(ko_text_raw) AS ko_nfc, trim(trim(nfc_normalize(ko_text_raw), chr(65279))) AS ko_sql_analysis, trim(trim(nfc_normalize(en_text_raw), chr(65279))) AS en_sql_analysis FROM pair_registry")
def normalized_sql_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda c: tx.outer_trim_spaces(tx.strip_edge_bom(tx.nfc(c)))
    return table(spark, sf_dir, "pair_registry").select("pair_id", tx.nfc("ko_text_raw").alias("ko_nfc"), form("ko_text_raw").alias("ko_sql_analysis"), form("en_text_raw").alias("en_sql_analysis"))


@query()
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tested form of normalization: edges lose all white space; with the reasons of unusual raw texts."""
    d = table(spark, sf_dir, "pair_registry")
    return d.select("pair_id", *(x for s in ("ko", "en") for x in (tx.analysis_text(f"{s}_text_raw").alias(f"{s}_analysis"), tx.anomaly_reasons(f"{s}_text_raw").alias(f"{s}_reasons"))))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE ko_text_raw <> ko_text_analysis) AS ko_raw_differs, count(*) FILTER (WHERE ko_text_nfc <> ko_text_analysis) AS ko_nfc_differs, count(*) FILTER (WHERE en_text_raw <> en_text_analysis) AS en_raw_differs FROM pair_registry")
def text_variant_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = lambda a, b: F.count_if(F.col(a) != F.col(b))
    return table(spark, sf_dir, "pair_registry").agg(F.count("*").alias("n"), off("ko_text_raw", "ko_text_analysis").alias("ko_raw_differs"), off("ko_text_nfc", "ko_text_analysis").alias("ko_nfc_differs"), off("en_text_raw", "en_text_analysis").alias("en_raw_differs"))


@query("SELECT count(*) AS rows_seen, count(DISTINCT pair_id) AS ids, count(*) FILTER (WHERE pair_id IS NULL) AS null_ids, count(*) FILTER (WHERE ko_text_nfc IS NULL OR en_text_nfc IS NULL OR pair_quality_status IS NULL OR length_stratum IS NULL) AS null_required FROM pair_registry")
def post_write_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = ["ko_text_nfc", "en_text_nfc", "pair_quality_status", "length_stratum"]
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull()
    return table(spark, sf_dir, "pair_registry").agg(F.count("*").alias("rows_seen"), F.count_distinct("pair_id").alias("ids"), F.count_if(F.col("pair_id").isNull()).alias("null_ids"), F.count_if(missing).alias("null_required"))


@query("SELECT domain, count(*) AS n FROM pair_registry WHERE domain NOT IN ('general', 'dialogue', 'technology') AND domain IS NOT NULL GROUP BY domain")
def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validate import unmapped

    return unmapped(table(spark, sf_dir, "pair_registry"), "domain", ["general", "dialogue", "technology"]).withColumnRenamed("value", "domain")


@query("SELECT 'left_only' AS side, count(*) AS n FROM (SELECT DISTINCT pair_id FROM pair_registry WHERE pair_id NOT IN (SELECT pair_id FROM rep_features WHERE pair_id IS NOT NULL)) UNION ALL SELECT 'right_only', count(*) FROM (SELECT DISTINCT pair_id FROM rep_features WHERE pair_id NOT IN (SELECT pair_id FROM pair_registry WHERE pair_id IS NOT NULL))")
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.key_difference(table(spark, sf_dir, "pair_registry"), table(spark, sf_dir, "rep_features"), "pair_id")
