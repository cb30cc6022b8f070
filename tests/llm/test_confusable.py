from __future__ import annotations

import re

import pytest

from pairloom.llm import confusable as c
from pairloom.llm import garble


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tһe Сooperativе", "the Cooperative"), ("Nօ. 10 ﬁrst", "No. 10 first"), ("５７１７번째　ｔｅｘｔ．", "5717번째 text."), ("cafe\u0301", "caf\u00e9"), ("﻿기술​은﻿", "기술은"), ("가ㅤ나 다", "가 나 다"), ("\u1112\u1161\u11ab\u1100\u1173\u11af", "\ud55c\uae00"),
        ("화력(⽕⼒)", "화력(火力)"), ("\uf90a", "\u91d1"), ("NY‐65168 HA‑1", "NY-65168 HA-1"), ("НК-58651 code", "HK-58651 code"), ("ɑt tɑsty", "at tasty"), ("la͏bor­atory", "laboratory"), ("гoрод стоит", "город стоит"), ("Ⅷ", "VIII"),
        ("Ꭰavid", "David"), ("Ⲥat", "Cat"), ("ᴛest", "test"), ("人ロ 조사", "人口 조사"), ("二ー", "二一"), ("ㅣove", "love"), ("丨ove", "love"), ("№ 5 ㎏", "No 5 kg"), ("Μ's о x", "M's o x"), ("sσmе", "some"), ("Tһе water", "The water"), ("Tһе город", "Тһе город"), ("Тһе siѕter", "The sister"),
    ],
)
def test_forms_become_ordinary(text, want):
    got, why = c.consistent(text)
    assert got == want and why


@pytest.mark.parametrize("text", ["", "plain text", "한국어 문장 “인용” – 끝…", "café naïve Ångström AÇÃO", "(слово) вечер λόγος", "👩‍💻 ❤️ 👨‍👩‍👧 1️⃣", "金利 화력(火力)", "€5 ² ½ ™", "می‌خواهم", "сор и рост", "the word сор stands alone", "ΝΑΙ", "カタカナ人ロ", "ㅋㅋ ㅣ ㅡㅡ", "네ー", "カー", "tabs\tand\nlines", "「인용」 «x»"])
def test_genuine_texts_stay(text):
    assert c.consistent(text) == (text, [])


def test_consistent_form_is_a_fixed_point():
    for t in ("tһe Сat ﬁt", "ｆｕｌｌ　한글​", "гoрод", "é​⽕"):
        once = c.consistent(t)[0]
        assert c.consistent(once) == (once, [])


def test_tables(spark):
    rows = [("a", "tһe", "plain"), ("b", None, ""), (None, "tһe", "x"), ("c", "가​" * 20_000, "y"), ("d", "ë§ì", "z"), ("e", "말", "w")]
    d = spark.createDataFrame(rows, "pair_id string, ko_text_nfc string, en_text_nfc string").selectExpr("*", "ko_text_nfc as ko_text_analysis", "en_text_nfc as en_text_analysis", "1 as reasons", "2 as id")
    found = {tuple(r) for r in c.lookalike_sides(d).collect()}
    assert ("a", "ko") in found and ("c", "ko") in found and ("e", "ko") not in found and ("b", "en") not in found
    every = c.consistent_sides(d)
    assert every.count() == 9 and every.where("side = 'ko' and pair_id = 'a'").first().consistent_text == "the"
    assert c.lookalike_sides(d.limit(0)).count() == 0


def test_garbled_sides_are_left_out(spark):
    words = "카페에서 마을이 자전거를 청소했습니다"
    bad = garble.garbled(words, garble.CHAINS[0]) + " ​"
    d = spark.createDataFrame([("a", words, "x"), ("b", bad, "x"), ("c", words + "​", "x")], "pair_id string, ko_text_nfc string, en_text_nfc string").selectExpr("*", "ko_text_nfc as ko_text_analysis", "en_text_nfc as en_text_analysis")
    assert {tuple(r) for r in c.lookalike_sides(d).collect()} == {("c", "ko")}


def test_the_prefilter_passes_nothing_that_changes(spark):
    usual = re.compile(c.JVM_UNUSUAL)
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000 and not usual.match(chr(p))]
    assert not [x for x in points if c.consistent(x) != (x, []) or c.consistent(f"a{x}a 가{x}") != (f"a{x}a 가{x}", [])] and {"é", "ß", "·", "힣"} <= set(points)
    d = spark.createDataFrame([(x, f"sea{x}e", "plain") for x in "ıſƖǀȷĲǆé"], "pair_id string, ko_text_nfc string, en_text_nfc string")
    got = {r.pair_id: r.consistent_text for r in c.consistent_sides(d).where("side = 'ko' and size(reasons) > 0").collect()}
    assert got == {x: c.consistent(f"sea{x}e")[0] for x in "ıſƖǀȷĲǆ"}
