"""Quality control of a text pair: flags, rejection, language-side review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as tx

# Thresholds and the pattern of markup.
MARKUP = r"</?[A-Za-z][^>]*>|https?://[^\s]+|www\.[^\s]+|[A-Za-z_][A-Za-z0-9_]*\([^)]*\)"
MARKUP_SHARE, CONTROL_SHARE, DIGIT_SHARE, PUNCT_SHARE, SCRIPT_SHARE, EVIDENCE, STRATA = 0.5, 0.05, 0.20, 0.20, 0.10, 5, 5
PREFIX = 7  # characters of a key that part the rows of one length
HARD_FLAGS = ("empty_text_flag", "decode_integrity_flag", "markup_dominant_flag", "control_char_excess_flag", "exact_duplicate_flag")
PRIMARY = ("025", "026")


def markup_length(text: str | Column) -> Column:
    """Characters inside tags, links and calls, all matches together."""
    found = F.regexp_extract_all(text, F.lit(f"({MARKUP})"), F.lit(1))
    return F.aggregate(F.transform(found, F.length), F.lit(0), lambda a, b: a + b)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def language_reason(hangul: Column, latin: Column, side: str) -> Column:
    """Why a side may be of the wrong language; advisory."""
    own, other, name = (hangul, latin, "KO_NO_HANGUL_LATIN_DOMINANT") if side == "ko" else (latin, hangul, "EN_NO_LATIN_HANGUL_DOMINANT")
    return F.when(hangul + latin < EVIDENCE, "INSUFFICIENT_LINGUISTIC_EVIDENCE").when((own == 0) & (other >= EVIDENCE), name).otherwise("NONE")


def side_flags(raw: str, analysis: str, side: str) -> dict[str, Column]:
    """Conditions of one side; an empty text has share 0 of everything."""
    a, r = F.col(analysis), F.col(raw)
    n = F.length(a)
    control = tx.count(a, r"[\p{Cc}&&[^\t\n]]")
    hangul, latin, alnum = tx.count(a, "[가-힣]"), tx.count(a, "[A-Za-z]"), tx.count(a, r"[\p{L}\p{N}]")
    return {
        "empty": a == "",
        "decode": F.contains(a, F.lit("�")),
        "markup": share(markup_length(a), n) > MARKUP_SHARE,
        "control": (control + tx.count(a, r"[​‌‍﻿]")) / F.greatest(n, F.lit(1)) > CONTROL_SHARE,
        "unicode": F.contains(tx.strip_edge_bom(r), F.lit("﻿")) | r.rlike(r"[​‌‍]") | (control > 0) | r.rlike(r"(?:^|\s)\p{M}"),
        "digit": share(tx.count(a, r"\p{N}"), n) > DIGIT_SHARE,
        "punct": share(tx.count(a, r"\p{P}"), n) > PUNCT_SHARE,
        "mix": (share(hangul, alnum) >= SCRIPT_SHARE) & (share(latin, alnum) >= SCRIPT_SHARE),
        "reason": language_reason(hangul, latin, side),
    }


def deferred() -> dict[str, Column]:
    """Columns of a stage that is yet to run: typed nulls, and a status that says so."""
    return {"translation_quality_review_flag": F.lit(None).cast("boolean"), "named_entity_heavy_flag": F.lit(None).cast("boolean"), "named_entity_evaluation_status": F.lit("DEFERRED")}


def direction(record: Column, expected: Column) -> dict[str, Column]:
    """``translation_direction_raw`` and its review flag from a record's fields (a map of strings) and the direction its file stands for.

    Two signals: the pair of languages, and which original there is. Both agree with the file: that direction. No
    original, but the languages agree with it: that direction, to be reviewed. Anything else: UNKNOWN, to be reviewed.
    """
    source, target = F.try_element_at(record, F.lit("source_language")), F.try_element_at(record, F.lit("target_language"))
    there = {s: F.coalesce(F.try_element_at(record, F.lit(f"{s}_original")), F.lit("")) != "" for s in ("ko", "en")}
    of_languages = F.when((source == "ko") & (target == "en"), "KO_TO_EN").when((source == "en") & (target == "ko"), "EN_TO_KO")
    of_original = F.when(there["ko"] & ~there["en"], "KO_TO_EN").when(there["en"] & ~there["ko"], "EN_TO_KO")
    agrees = F.coalesce(of_languages == expected, F.lit(False))
    strong = agrees & F.coalesce(of_original == expected, F.lit(False))
    found = F.when(strong | agrees & of_original.isNull(), expected).otherwise("UNKNOWN")
    return {"translation_direction_raw": found, "translation_direction_review_flag": ~strong}


def rejection(flags: dict[str, Column]) -> dict[str, Column]:
    """Primary reason (the first true hard flag), the other true ones as a JSON list, and the status."""
    first = None
    for name in HARD_FLAGS:
        first = F.when(flags[name], name) if first is None else first.when(flags[name], name)
    rest = F.slice(F.filter(F.array(*(F.when(flags[n], n) for n in HARD_FLAGS)), lambda x: x.isNotNull()), 2, len(HARD_FLAGS))
    return {"primary_rejection_reason": first, "secondary_rejection_flags": F.to_json(rest), "pair_quality_status": F.when(first.isNull(), "accepted").otherwise("rejected")}


def length_strata(df: DataFrame, length: Column, key: str, n: int = STRATA, out: str = "length_quintile") -> DataFrame:
    """Equal-sized strata of the total order of ``length`` and ``key``, the first ones one row longer.

    An ntile window would gather all rows in one task. Here rows are counted by length and
    by the first characters of a text key, the counts give each such part its first rank,
    and rows are numbered within parts only; a stratum follows from the rank. Parts keep
    a length that very many rows share from being sorted in one task.
    """
    part = F.substring(key, 1, PREFIX) if isinstance(df.schema[key].dataType, StringType) else F.lit("")
    d = df.withColumns({"_len": length, "_part": part})
    sizes = d.groupBy("_len", "_part").agg(F.count("*").alias("_c"))
    per = sizes.groupBy("_len").agg(F.sum("_c").alias("_n"))
    lens = per.select(F.col("_len").alias("_l"), (F.sum("_n").over(Window.orderBy("_len")) - F.col("_n")).alias("_below"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inside = F.sum("_c").over(Window.partitionBy("_len").orderBy("_part")) - F.col("_c")
    first = sizes.select("_len", F.col("_part").alias("_p"), inside.alias("_inside")).join(lens, F.col("_len").eqNullSafe(F.col("_l"))).select("_l", "_p", "_total", (F.col("_below") + F.col("_inside")).alias("_before"))
    ranked = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_len", "_part").orderBy(key)))
    ranked = ranked.join(first, F.col("_len").eqNullSafe(F.col("_l")) & F.col("_part").eqNullSafe(F.col("_p")))
    rank = F.col("_before") + F.col("_rn") - 1
    base, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    in_long = rank < extra * (base + 1)
    stratum = F.when(in_long, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - extra * (base + 1)) / F.greatest(base, F.lit(1)))) + 1
    return ranked.withColumn(out, stratum.cast("int")).drop("_len", "_part", "_l", "_p", "_before", "_total", "_rn")


def analysis_representative(df: DataFrame, group: str, key: str, eligible: Column) -> DataFrame:
    """Per group the smallest eligible key, else the smallest key: an aggregate joined back, so a hot group is never gathered."""
    reps = df.groupBy(group).agg(F.coalesce(F.min(F.when(eligible, F.col(key))), F.min(key)).alias("analysis_representative_pair_id"))
    return df.join(reps.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def quality_columns(df: DataFrame, ko: str = "ko_text_analysis", en: str = "en_text_analysis", ko_raw: str = "ko_text_raw", en_raw: str = "en_text_raw") -> DataFrame:
    """The QC columns of a registry that has raw and analysis texts, ``duplicate_group_id`` and ``logical_corpus``.

    Existing columns of the same names are replaced. Null text counts as empty. Rows keep their number.
    """
    new = [*HARD_FLAGS, "unicode_anomaly_flag", "high_digit_ratio_flag", "high_punctuation_ratio_flag", "script_mix_flag", "ko_lang_side_anomaly_reason", "en_lang_side_anomaly_reason"]
    new += ["lang_side_anomaly_review_flag", "lang_side_anomaly_reason", "primary_rejection_reason", "secondary_rejection_flags", "pair_quality_status", "length_quintile", "length_stratum"]
    new += ["short_text_flag", "long_text_flag", "duplicate_disposition", "analysis_eligible_exact_dedup", "analysis_representative_pair_id"]
    d = df.drop(*new).fillna("", [ko, en, ko_raw, en_raw])
    d = analysis_representative(d, "duplicate_group_id", "pair_id", F.col("logical_corpus").isin(*PRIMARY))
    d = length_strata(d, F.length(en), "pair_id")
    k, e = side_flags(ko_raw, ko, "ko"), side_flags(en_raw, en, "en")
    d = d.withColumns({
        "empty_text_flag": k["empty"] | e["empty"], "decode_integrity_flag": k["decode"] | e["decode"], "markup_dominant_flag": k["markup"] | e["markup"],
        "control_char_excess_flag": k["control"] | e["control"], "exact_duplicate_flag": F.col("pair_id") != F.col("analysis_representative_pair_id"),
        "unicode_anomaly_flag": k["unicode"] | e["unicode"], "high_digit_ratio_flag": k["digit"] | e["digit"], "high_punctuation_ratio_flag": k["punct"] | e["punct"],
        "script_mix_flag": k["mix"] | e["mix"], "ko_lang_side_anomaly_reason": k["reason"], "en_lang_side_anomaly_reason": e["reason"],
    })
    kr, er = F.col("ko_lang_side_anomaly_reason"), F.col("en_lang_side_anomaly_reason")
    return d.withColumns({
        **rejection({n: F.col(n) for n in HARD_FLAGS}),
        "lang_side_anomaly_review_flag": (kr != "NONE") | (er != "NONE"), "lang_side_anomaly_reason": F.when(kr != "NONE", kr).otherwise(er),
        "length_stratum": F.concat(F.lit("Q"), F.col("length_quintile").cast("string")), "short_text_flag": F.col("length_quintile") == 1, "long_text_flag": F.col("length_quintile") == STRATA,
        "duplicate_disposition": F.when(F.col("exact_duplicate_flag"), "NON_REPRESENTATIVE_DUPLICATE").otherwise("REPRESENTATIVE"), "analysis_eligible_exact_dedup": ~F.col("exact_duplicate_flag"),
    })
