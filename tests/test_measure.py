from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import morphology as mo
from pairloom.functions import tokenizer as tk

SAMPLES = ["안녕하세요.", "The price is $3.50.", "한글 mixed English", "a\n\tb", " edge ", "abc123", "!!!", "a", "👩‍💻", "https://x.org/y?z=1", ""]


def test_morph_features(spark):
    d = spark.createDataFrame([([("먹", "VV"), ("었", "EP"), ("다", "EF"), ("는", "JX"), ("하", "XSA-I")], 2), ([], 3), (None, 1), ([("x", "NNG")], 0)], "morpheme_sequence array<struct<form:string,pos:string>>, eojeol_count long")
    a, b, c, e = d.select(*(v.alias(k) for k, v in mo.morph_features().items())).collect()
    assert (a.morpheme_count, a.particle_count, a.ending_count, a.deriv_affix_count) == (5, 1, 2, 1)
    assert a.morpheme_density == 2.5 and a.function_morpheme_ratio == pytest.approx(0.6)
    assert b.particle_ratio is None and b.analysis_warning_flag and b.morpheme_density == 0
    assert e.morpheme_density is None


def test_analyzer_slot_keeps_order(spark):
    d = spark.createDataFrame([(i, "가 " * i) for i in range(20)], "k long, t string")
    got = mo.analyze(d, "k", "t", lambda: lambda batch: [[(w, "NNG") for w in t.split()] for t in batch])
    assert {r.k: len(r.morpheme_sequence) for r in got.collect()} == {i: i for i in range(20)}


def test_tokens_round_trip_and_identity(spark):
    d = spark.createDataFrame([("짧다", "short"), ("같은", "같은"), ("긴 한국어 문장입니다", "a long English sentence")], "ko string, en string")
    d = tk.with_token_ids(d, {"ko_": "ko", "en_": "en"})
    d = d.select("*", *(c.alias(n) for s in ("ko", "en") for n, c in ((f"{s}_tokens", F.size(f"{s}_token_ids")), (f"{s}_codepoints", F.length(s)), (f"{s}_bytes", F.octet_length(s)))))
    for r in d.select("*", *(c.alias(k) for k, c in tk.decomposition().items())).collect():
        assert r.ko_roundtrip_ok and r.en_roundtrip_ok and r.identity_abs_error < 1e-10
        assert r.log_token_premium == pytest.approx(math.log(r.ko_tokens / r.en_tokens))
        if r.ko == r.en:
            assert r.token_premium == 1


def test_chunks_tile_and_match(spark):
    d = tk.with_chunk_tokens(spark.createDataFrame([(s,) for s in SAMPLES] + [(None,)], "t string"), {"": "t"})
    assert all(r.chunks_tile and r.chunk_tokens_match for r in d.collect())


def test_chunk_statistics(spark):
    d = spark.createDataFrame([(["abc", " 12", "!", "가나"],), ([],)], "a array<string>")
    a, b = d.select(*(c.alias(k) for k, c in tk.chunk_statistics("a").items())).collect()
    assert (a.chunk_count, a.chunk_byte_total, a.max_chunk_bytes, a.p50_chunk_bytes, a.p90_chunk_bytes) == (4, 13, 6, 3.0, 6.0)
    assert a.chunk_type_share_letter == 0.5 and a.chunk_type_share_number == 0.25 and a.chunk_type_share_punctuation == 0.25
    assert b.mean_chunk_bytes is None and b.p50_chunk_bytes is None and b.p90_chunk_bytes is None


def test_wrong_vocabulary_is_refused():
    with pytest.raises(ValueError):
        tk.vocabulary_path(sha256="0" * 64)


def test_rank_hash_is_stable():
    path = tk.vocabulary_path()
    assert tk.rank_hash(path) == tk.rank_hash(path) and len(tk.rank_hash(path)) == 64
