"""Queries over surface features of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregate as ag
from ..operators.relations import latest_rows
from ..session import spread, table
from .registry import query

WS = r"\t-\r \x{85}\p{Z}"


def _n(column: str, pattern: str) -> str:
    """SQL: how many characters of a class."""
    return f"length(regexp_replace({column}, '[^{pattern}]', '', 'g'))"


def _features_sql(c: str, p: str) -> str:
    h, latin = r"\p{Hangul}", r"\p{Latin}"
    counts = {"h": _n(c, h), "l": _n(c, latin), "d": _n(c, r"\p{Nd}"), "p": _n(c, r"\p{P}"), "s": _n(c, WS)}
    n = f"nullif(length({c}), 0)"
    neutral = rf"regexp_replace({c}, '[\p{{Nd}}\p{{P}}{WS}]', '', 'g')"
    seq = rf"regexp_replace(regexp_replace(regexp_replace({neutral}, '[^{h}{latin}]', chr(57347), 'g'), '{h}', chr(57345), 'g'), '{latin}', chr(57346), 'g')"
    squeezed = f"regexp_replace(regexp_replace(regexp_replace({seq}, chr(57345)||'+', chr(57345), 'g'), chr(57346)||'+', chr(57346), 'g'), chr(57347)||'+', chr(57347), 'g')"
    types = " + ".join(f"contains({seq}, chr({57345 + k}))::BIGINT" for k in range(3))
    return f"""length({c}) AS {p}codepoint_count, length_grapheme({c}) AS {p}grapheme_count, octet_length(encode({c})) AS {p}utf8_bytes,
      {counts['s']} AS {p}whitespace_count, length(regexp_replace(regexp_replace({c}, '[{WS}]+', chr(1), 'g'), '[^\\x01]', '', 'g')) AS {p}space_run_count,
      round({counts['h']} / {n}, 9) AS {p}hangul_share, round({counts['l']} / {n}, 9) AS {p}latin_share, round({counts['d']} / {n}, 9) AS {p}digit_share,
      round({counts['p']} / {n}, 9) AS {p}punctuation_share,
      round((length({c}) - {' - '.join(counts.values())}) / {n}, 9) AS {p}symbol_other_share,
      {types} AS {p}script_type_count, greatest(length({squeezed}) - 1, 0) AS {p}script_switch_count,
      regexp_matches({c}, '(?i)(?:https?://|www\\.)\\S+') AS {p}url_flag, regexp_matches({c}, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}') AS {p}email_flag,
      regexp_matches({c}, '{tx.EMOJI}') AS {p}emoji_flag"""


SHOWN = ("codepoint_count", "grapheme_count", "utf8_bytes", "whitespace_count", "space_run_count", "hangul_share", "latin_share", "digit_share", "punctuation_share", "symbol_other_share", "script_type_count", "script_switch_count", "url_flag", "email_flag", "emoji_flag")


def _shown(column: str, prefix: str) -> list:
    f = tx.side_features(column, prefix)
    return [(F.round(f[prefix + k], 9) if k.endswith("share") else f[prefix + k]).alias(prefix + k) for k in SHOWN]


@query(f"SELECT pair_id, {_features_sql('ko_text_analysis', 'ko_')}, {_features_sql('en_text_analysis', 'en_')} FROM pair_registry")
def side_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pair_registry").select("pair_id", "ko_text_analysis", "en_text_analysis")).select("pair_id", *_shown("ko_text_analysis", "ko_"), *_shown("en_text_analysis", "en_"))


@query(
    r"""SELECT pair_id, round(length(ko_text_analysis) / nullif(length(en_text_analysis), 0), 9) AS pair_codepoint_ratio,
  round(length_grapheme(ko_text_analysis) / nullif(length_grapheme(en_text_analysis), 0), 9) AS pair_grapheme_ratio,
  round(octet_length(encode(ko_text_analysis)) / nullif(octet_length(encode(en_text_analysis)), 0), 9) AS pair_byte_ratio,
  length(ko_text_analysis) - length(en_text_analysis) AS pair_codepoint_diff FROM pair_registry"""
)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = ("codepoint_count", "grapheme_count", "utf8_bytes")
    d = table(spark, sf_dir, "pair_registry").select("pair_id", *(tx.side_features(f"{s}_text_analysis")[k].alias(f"{s}_{k}") for s in ("ko", "en") for k in need))
    return d.select("pair_id", *(F.round(c, 9).alias(k) if k.endswith("ratio") else c.alias(k) for k, c in tx.pair_features().items()))


@query(
    rf"""WITH f AS (SELECT lang, length(text)::DOUBLE AS cp, octet_length(encode(text))::DOUBLE AS nb, {_n('text', WS)}::DOUBLE AS ws,
    len(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> ''))::DOUBLE AS words FROM documents)
SELECT lang, count(*) AS n_texts, round(quantile_cont(cp, 0.5), 6) AS codepoints_p50, round(quantile_cont(cp, 0.95), 6) AS codepoints_p95,
  round(quantile_cont(nb, 0.5), 6) AS bytes_p50, round(avg(ws / nullif(cp, 0)), 9) AS whitespace_density, round(quantile_cont(words, 0.5), 6) AS words_p50 FROM f GROUP BY lang"""
)
def text_profile_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.side_features("text")
    d = table(spark, sf_dir, "documents").select("lang", f["codepoint_count"].alias("cp"), f["utf8_bytes"].alias("by"), f["whitespace_density"].alias("ws"), tx.segment_count("text").alias("words"))
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return d.groupBy("lang").agg(
        F.count("*").alias("n_texts"), q("cp", 0.5).alias("codepoints_p50"), q("cp", 0.95).alias("codepoints_p95"), q("by", 0.5).alias("bytes_p50"), F.round(F.avg("ws"), 9).alias("whitespace_density"), q("words", 0.5).alias("words_p50")
    )


@query(
    rf"""SELECT pair_id, len(list_filter(regexp_split_to_array(ko_text_analysis, '[{WS}]+'), lambda x: x <> '')) AS ko_eojeol_count,
  len(list_filter(regexp_split_to_array(en_text_analysis, '[{WS}]+'), lambda x: x <> '')) AS en_word_count FROM pair_registry"""
)
def lexical_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pair_registry").select("pair_id", tx.segment_count("ko_text_analysis").alias("ko_eojeol_count"), tx.segment_count("en_text_analysis").alias("en_word_count"))


@query(
    r"""WITH f AS (SELECT regexp_matches(t, '[{};]')::INT AS b, contains(t, '=>')::INT AS a,
    regexp_matches(t, '(?i)\b(?:function|def|import|class|return|const|let|var)\b')::INT AS k, regexp_matches(t, '[\p{L}\p{M}\p{Nd}\p{Pc}]+\([^)]*\)')::INT AS c
  FROM (SELECT text AS t FROM documents))
SELECT alternative, sum(m)::BIGINT AS matches, sum((m = 1 AND s = 1)::INT)::BIGINT AS sole FROM (
  SELECT 'brace_or_semicolon' AS alternative, b AS m, b+a+k+c AS s FROM f UNION ALL SELECT 'arrow', a, b+a+k+c FROM f UNION ALL
  SELECT 'keyword', k, b+a+k+c FROM f UNION ALL SELECT 'call', c, b+a+k+c FROM f) GROUP BY alternative"""
)
def code_like_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    alternatives = tx.code_alternatives("text")
    d = table(spark, sf_dir, "documents").select(*(c.cast("int").alias(k) for k, c in alternatives.items()))
    total = sum((F.col(k) for k in alternatives), F.lit(0))
    d = d.select(F.inline(F.array(*(F.struct(F.lit(k).alias("alternative"), F.col(k).alias("m"), total.alias("s")) for k in alternatives))))
    return d.groupBy("alternative").agg(F.sum("m").alias("matches"), F.count_if((F.col("m") == 1) & (F.col("s") == 1)).alias("sole"))


NOISE = {
    "html_like": tx.HTML_LIKE, "url_like": tx.URL_LIKE, "email_like": tx.EMAIL_LIKE, "control_character": tx.CONTROL, "zero_width": tx.ZERO_WIDTH,
    "repeated_whitespace": r"[ \t]{2,}", "newline_or_tab": r"[\n\r\t]", "replacement_character": "�",
}


@query(
    "SELECT side, flag, sum(m::INT)::BIGINT AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS side, '{k}' AS flag, regexp_matches({s}_text_raw, '{p}') AS m FROM pair_registry" for s in ("ko", "en") for k, p in NOISE.items())
    + " UNION ALL SELECT 'ko', 'expected_script_absent', length(ko_text_raw) > 0 AND NOT regexp_matches(ko_text_raw, '[가-힣ㄱ-ㅎㅏ-ㅣ]') FROM pair_registry"
    + " UNION ALL SELECT 'en', 'expected_script_absent', length(en_text_raw) > 0 AND NOT regexp_matches(en_text_raw, '[A-Za-z]') FROM pair_registry) GROUP BY side, flag"
)
def raw_noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    out = None
    for side in ("ko", "en"):
        flags = {k: c for k, c in tx.noise_flags(f"{side}_text_raw", side).items() if k in NOISE or k == "expected_script_absent"}
        one = ag.counts_of(d, flags, "flag").select(F.lit(side).alias("side"), "flag", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def raw_noise_flags_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that SQL lacks: phone-like (look-behind), Unicode edges, NFKC change."""
    d = table(spark, sf_dir, "pair_registry")
    flags = {f"{s}_{k}": c for s in ("ko", "en") for k, c in tx.noise_flags(f"{s}_text_raw", s).items() if k in ("phone_like", "leading_or_trailing_whitespace", "empty", "nfkc_change")}
    return ag.counts_of(d, flags, "flag")


RULES = {
    "codepoints_positive": "ko_codepoint_count <= 0 OR en_codepoint_count <= 0",
    "bytes_below_codepoints": "ko_utf8_bytes < ko_codepoint_count OR en_utf8_bytes < en_codepoint_count",
    "bytes_above_four_per_codepoint": "ko_utf8_bytes > 4 * ko_codepoint_count OR en_utf8_bytes > 4 * en_codepoint_count",
    "graphemes_above_codepoints": "ko_grapheme_count > ko_codepoint_count OR en_grapheme_count > en_codepoint_count",
    "runs_above_whitespace": "ko_space_run_count > ko_whitespace_count OR en_space_run_count > en_whitespace_count",
    "lexical_zero": "ko_eojeol_count = 0 OR en_word_count = 0",
    "lexical_above_runs": "ko_eojeol_count > ko_space_run_count + 1 OR en_word_count > en_space_run_count + 1",
    "share_out_of_range": " OR ".join(f"{s}_{k}_share < 0 OR {s}_{k}_share > 1" for s in ("ko", "en") for k in ("hangul", "latin", "digit", "punctuation", "symbol_other")),
    "shares_not_one": " OR ".join(f"abs({s}_hangul_share + {s}_latin_share + {s}_digit_share + {s}_punctuation_share + {s}_symbol_other_share + {s}_whitespace_density - 1) > 1e-9" for s in ("ko", "en")),
    "switch_without_types": "(ko_script_type_count < 2 AND ko_script_switch_count > 0) OR (en_script_type_count < 2 AND en_script_switch_count > 0)",
    "density_definition": " OR ".join(f"abs({s}_whitespace_density - {s}_whitespace_count / {s}_codepoint_count) > 1e-12" for s in ("ko", "en")),
    "bytes_per_codepoint_definition": " OR ".join(f"abs({s}_bytes_per_codepoint - {s}_utf8_bytes / {s}_codepoint_count) > 1e-12" for s in ("ko", "en")),
    "pair_ratio_definition": "abs(pair_codepoint_ratio - ko_codepoint_count / en_codepoint_count) > 1e-12",
    "pair_diff_definition": "pair_codepoint_diff <> ko_codepoint_count - en_codepoint_count",
}


@query("SELECT rule, n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {p.replace(' / ', ' * 1.0::DOUBLE / ')}) AS n FROM rep_features" for k, p in RULES.items()) + ")")
def feature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.counts_of(table(spark, sf_dir, "rep_features"), {k: F.expr(p) for k, p in RULES.items()})


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC, ko_codepoint_count DESC) AS k FROM rep_features)
SELECT count(*) AS n, count(*) FILTER (WHERE ko_codepoint_count <> length(ko_text_analysis)) AS ko_codepoints, count(*) FILTER (WHERE en_codepoint_count <> length(en_text_analysis)) AS en_codepoints,
  count(*) FILTER (WHERE ko_utf8_bytes <> octet_length(encode(ko_text_analysis))) AS ko_bytes, count(*) FILTER (WHERE ko_grapheme_count <> length_grapheme(ko_text_analysis)) AS ko_graphemes
FROM l JOIN pair_registry USING (pair_id) WHERE k = 1"""
)
def stored_feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features against those of the texts, latest measurement of each pair."""
    stored = latest_rows(table(spark, sf_dir, "rep_features"), "pair_id", "measured_at", ["ko_codepoint_count"], ["pair_id", "ko_codepoint_count", "en_codepoint_count", "ko_utf8_bytes", "ko_grapheme_count"])
    texts = table(spark, sf_dir, "pair_registry").select("pair_id", "ko_text_analysis", "en_text_analysis")
    ko, en = tx.side_features("ko_text_analysis"), tx.side_features("en_text_analysis")
    off = lambda c, f: F.count_if(F.col(c) != f)
    return stored.join(texts, "pair_id").agg(
        F.count("*").alias("n"), off("ko_codepoint_count", ko["codepoint_count"]).alias("ko_codepoints"), off("en_codepoint_count", en["codepoint_count"]).alias("en_codepoints"),
        off("ko_utf8_bytes", ko["utf8_bytes"]).alias("ko_bytes"), off("ko_grapheme_count", ko["grapheme_count"]).alias("ko_graphemes"),
    )
