from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import quality as ql


def registry(spark, rows):
    d = spark.createDataFrame([(f"p{i}", "025", r[2] if len(r) > 2 else f"g{i}", r[0], r[1]) for i, r in enumerate(rows)], "pair_id string, logical_corpus string, duplicate_group_id string, ko string, en string")
    return d.select("*", *(F.col(s).alias(f"{s}_text_{k}") for s in ("ko", "en") for k in ("raw", "analysis")))


def test_flags_and_rejection(spark):
    rows = [("안녕하세요 여러분", "hello there everyone", "g"), ("안녕하세요 여러분", "hello there everyone", "g"), ("", "empty side here"), ("깨진 � 글자", "broken text"), ("<b></b><i></i>x", "markup"), ("\x01\x02ab", "control"), (None, "null side here")]
    got = {r.pair_id: r for r in ql.quality_columns(registry(spark, rows)).collect()}
    assert got["p0"].pair_quality_status == "accepted" and got["p0"].secondary_rejection_flags == "[]"
    assert got["p1"].primary_rejection_reason == "exact_duplicate_flag" and got["p1"].analysis_representative_pair_id == "p0"
    assert got["p2"].primary_rejection_reason == "empty_text_flag" and got["p6"].empty_text_flag
    assert got["p3"].primary_rejection_reason == "decode_integrity_flag"
    assert got["p4"].markup_dominant_flag and got["p5"].control_char_excess_flag and got["p5"].unicode_anomaly_flag
    assert len(got) == 7


def test_secondary_flags_keep_order(spark):
    got = ql.quality_columns(registry(spark, [("�", "", "g"), ("�", "", "g")])).where("pair_id = 'p1'").first()
    assert got.primary_rejection_reason == "empty_text_flag"
    assert got.secondary_rejection_flags == '["decode_integrity_flag","exact_duplicate_flag"]'


def test_language_side(spark):
    got = {r.pair_id: r for r in ql.quality_columns(registry(spark, [("all english words", "hello there"), ("한국어 문장입니다", "한국어 문장입니다"), ("가", "a")])).collect()}
    assert got["p0"].ko_lang_side_anomaly_reason == "KO_NO_HANGUL_LATIN_DOMINANT"
    assert got["p1"].en_lang_side_anomaly_reason == "EN_NO_LATIN_HANGUL_DOMINANT"
    assert got["p2"].lang_side_anomaly_reason == "INSUFFICIENT_LINGUISTIC_EVIDENCE"


def test_strata_equal_ntile(spark):
    d = spark.createDataFrame([(f"k{i:03d}", "x" * (i % 7)) for i in range(103)], "k string, t string")
    mine = ql.length_strata(d, F.length("t"), "k").select("k", "length_quintile")
    d.createOrReplaceTempView("strata")
    want = spark.sql("SELECT k, ntile(5) OVER (ORDER BY length(t), k) AS q FROM strata")
    assert {tuple(r) for r in mine.collect()} == {tuple(r) for r in want.collect()}


def test_fewer_rows_than_strata_and_none(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "xx")], "k string, t string")
    assert sorted(r.length_quintile for r in ql.length_strata(d, F.length("t"), "k").collect()) == [1, 2]
    assert ql.length_strata(d.limit(0), F.length("t"), "k").count() == 0


def test_existing_columns_are_replaced(spark):
    d = registry(spark, [("안녕하세요", "hello you")]).withColumn("empty_text_flag", F.lit("clash"))
    assert ql.quality_columns(d).first().empty_text_flag is False


def test_strata_with_hot_length_null_length_and_number_key(spark):
    d = spark.createDataFrame([(i, f"pair_{i * 7919 % 4096:04x}", "same" if i % 3 else None) for i in range(300)], "n long, k string, t string")
    d.createOrReplaceTempView("hot")
    for key in ("k", "n"):
        want = {tuple(r) for r in spark.sql(f"SELECT {key}, ntile(5) OVER (ORDER BY length(t), {key}) AS q FROM hot").collect()}
        assert {tuple(r) for r in ql.length_strata(d, F.length("t"), key).select(key, "length_quintile").collect()} == want
