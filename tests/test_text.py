from __future__ import annotations

import unicodedata

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairloom.functions import text as tx

TEXTS = [
    "hello, world 42", "안녕 하세요", "한글 and English 섞음", "가A1가", "👩‍💻 ok", "é", "  a \t b\n", "http://x.org a@b.co", "Ⅷ²½", "ｆｕｌｌ", " ᄀ", "x{y};", "漢字 ok", "​zero", "...", "",
]
PATTERN = regex.compile(r"(?P<h>\p{Script=Hangul})|(?P<l>\p{Script=Latin})|(?P<d>\p{Nd})|(?P<p>\p{P})|(?P<s>\p{White_Space})|(?P<o>.)", regex.V1 | regex.DOTALL)


def brute(text: str) -> dict:
    groups = [m.lastgroup for m in PATTERN.finditer(text)]
    seq = [g for g in groups if g in "hlo"]
    runs = sum(1 for a, b in zip([None, *groups], groups) if b == "s" and a != "s")
    n = max(1, len(text))
    return {
        "codepoint_count": len(text), "grapheme_count": len(regex.findall(r"\X", text)), "utf8_bytes": len(text.encode()), "whitespace_count": groups.count("s"), "space_run_count": runs,
        "hangul_share": groups.count("h") / n, "latin_share": groups.count("l") / n, "digit_share": groups.count("d") / n, "punctuation_share": groups.count("p") / n, "symbol_other_share": groups.count("o") / n,
        "script_type_count": len(set(seq)), "script_switch_count": sum(a != b for a, b in zip(seq, seq[1:])), "emoji_flag": bool(regex.search(r"\p{Extended_Pictographic}", text)),
    }


def check(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    f = tx.side_features("t")
    for row in d.select("t", *(f[k].alias(k) for k in brute(""))).collect():
        for k, v in brute(row.t).items():
            got = row[k]
            if row.t == "" and k.endswith("share"):
                assert got is None
            else:
                assert got == pytest.approx(v), (row.t, k, got, v)


def test_side_features_equal_an_independent_count(spark):
    check(spark, TEXTS)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("가힣ㄱaZé09.,!  \t\n漢λЖ😀‍́${}"), max_size=30), min_size=60, max_size=60))
def test_side_features_on_random_texts(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize(("raw", "want"), [("﻿ab﻿", "ab"), ("  a  b  ", "a  b"), (" \t첫째\n\t둘째\n", "첫째\n\t둘째"), ("ｆｕｌｌ", "ｆｕｌｌ"), ("MiXeD", "MiXeD"), ("é", "é"), ("텍스﻿트", "텍스﻿트"), ("", "")])
def test_analysis_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.analysis_text("t")).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("텍스﻿트", ["INTERNAL_ZERO_WIDTH"]), ("﻿x﻿", []), ("a\x07b", ["CONTROL_CHARACTER"]), ("a\tb\n", []), (" ́x", ["ORPHAN_COMBINING_MARK"]), ("é", []), ("", [])])
def test_anomaly_reasons(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.anomaly_reasons("t")).first()[0] == want


def test_nfc_of_everything(spark):
    texts = ["é", "한글", "Å", "plain", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.nfc("t")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_segments(spark):
    d = spark.createDataFrame([("a b  c d",), ("",), (" ",), ("가 나\n다",)], "t string")
    assert [r[0] for r in d.select(tx.segment_count("t")).collect()] == [4, 0, 0, 3]


def test_noise_flags(spark):
    t = " <b>x</b>  call 010 1234 5678 www.a.b me@x.org\n​�"
    row = spark.createDataFrame([(t,)], "t string").select(*(c.alias(k) for k, c in tx.noise_flags("t", "ko").items())).first().asDict()
    assert all(row[k] for k in ("html_like", "url_like", "email_like", "phone_like", "zero_width", "replacement_character", "newline_or_tab", "repeated_whitespace", "expected_script_absent", "leading_or_trailing_whitespace"))
    assert not row["empty"] and not row["control_character"]


def test_null_and_long_text(spark):
    long = "가나다 abc " * 20_000
    d = spark.createDataFrame([(None,), (long,)], "t string")
    f = tx.side_features("t")
    a, b = d.select(*(f[k].alias(k) for k in f)).collect()
    assert a.codepoint_count is None and b.codepoint_count == len(long) and b.space_run_count == 40_000


def test_scalar_text_and_finite(spark):
    d = spark.createDataFrame([(1.0,), (1.5,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in d.select(tx.scalar_text("x")).limit(3).collect()] == ["1", "1.5", None]
    assert [r[0] for r in d.select(tx.is_finite("x")).collect()] == [True, True, False, False, False]
