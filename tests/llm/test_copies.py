from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import copies, fold, scripts

SCHEMA = "pair_id string, ko_text_analysis string, en_text_analysis string"


def brute(rows):
    """Keep and copies by canonical text itself."""
    groups: dict = {}
    for k, a, b in rows:
        if k is not None:
            key = tuple(sorted(fold.folded(t) for t in (a, b)))
            groups.setdefault(key, []).append(k)
    return sorted((min(v), k) for v in groups.values() for k in v if k != min(v))


def found(spark, rows, schema=SCHEMA):
    got = copies.format_copies(spark.createDataFrame(rows, schema)).collect()
    return sorted((r.keep_pair_id, r.copy_pair_id) for r in got)


def test_formats_of_one_record(spark):
    rows = [
        ("b", "드마루기술의 후원은 1254번째 소금이었다.", "The sponsorship was its salt number 1,254."),
        ("c", "드마루기술의후원은  1254번째소금이었다", "the SPONSORSHIP was its salt number 1254"),
        ("a", "The sponsorship was its salt number 1254!", "‘드마루기술의 후원은 1254번째 소금이었다’"),
        ("d", "드마루기술의 후원은 1254번째 소금이었다", "Тhe sроnsorship was its ｓalt number １254"),
        ("e", "드마루기술의 후원은 1255번째 소금이었다.", "The sponsorship was its salt number 1254."),
        ("f", "드마루기술의 후원은 1254번째 소금이었다.", "The sponsorship was its malt number 1254."),
    ]
    assert found(spark, rows) == [("a", "b"), ("a", "c"), ("a", "d")] == brute(rows)


def test_letters_that_only_resemble_others_stay_apart(spark):
    rows = [
        ("a", "σ 값은 2", "sigma σ is 2"), ("b", "o 값은 2", "sigma o is 2"), ("c", "C++ 언어", "language"), ("d", "C 언어", "language"), ("e", "가격 5", "price $5"), ("f", "가격 5", "price 5"),
        ("g", "> 인용문", "a > quote"), ("h", "인용문", "a quote"), ("i", "цοdе tεxt", "x"), ("j", "カ", "one"), ("k", "力", "one"), ("l", "ΝΑΙ", "yes"), ("m", "ναι", "yes"), ("n", "Σωτήρ", "no"), ("o", "σωτήρ", "no"),
    ]
    assert found(spark, rows) == [("g", "h"), ("l", "m"), ("n", "o")] == brute(rows)


def test_nulls_empty_long_and_repeated(spark):
    long = "가나다 ABC, " * 30_000
    rows = [("a", None, "x"), ("b", "", "X!"), ("c", None, None), ("d", "", "..."), (None, "y", "y"), ("e", long, long.lower()), ("f", long.replace(",", ""), long), ("g", "é", "1"), ("h", "é", "1"), ("i", "e", "1")]
    assert found(spark, rows) == [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")] == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    d = spark.createDataFrame([("a", "x", "y", 1, 2, 3), ("b", "X", "y", 1, 2, 3)], SCHEMA + ", key_hi int, _keep int, n_copies int")
    assert copies.format_copies(d).count() == 1
    kept = copies.collapse(d).collect()
    assert [(r.pair_id, r.n_copies, r.key_hi) for r in kept] == [("a", 2, 1)]


def test_one_group_with_a_third_of_all_rows(spark):
    d = spark.range(6000).select(F.format_string("k%05d", "id").alias("pair_id"), F.when(F.col("id") % 3 == 0, "같은 말").otherwise(F.format_string("말 %d", "id")).alias("ko_text_analysis"), F.lit("same words").alias("en_text_analysis"))
    got = copies.format_copies(d)
    assert got.count() == 1999 and {r[0] for r in got.select("keep_pair_id").distinct().collect()} == {"k00000"}


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    """With a hash that says all rows are equal, the two-pointer check and the exact regrouping still give the right groups."""
    rows = [("a", "x", "1"), ("b", "X.", "1"), ("c", "y", "2"), ("d", "Y", "2!"), ("e", "z", "3")]
    monkeypatch.setattr(copies, "record_keys", lambda df, k, a, b: df.select(k, F.lit(1).cast("long").alias("key_hi"), F.lit(1).cast("long").alias("key_lo")))
    assert found(spark, rows) == [("a", "b"), ("c", "d")]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("가각ㄱaAàéÅ .,!－ａ１1-​́СcοΟﬁfi"), max_size=40), st.text(st.sampled_from("가각aA .,１1ﬁfi"), max_size=40))
def test_two_pointers_equal_canonical_comparison(a, b):
    same = fold.folded(a) == fold.folded(b)
    assert fold.two_pointer_equal(a, b, 3) == same
    assert fold.two_pointer_equal(a, " ".join(a) + "!", 5) or scripts.ODD.search(a)  # what a letter passes for depends on its word
    codes, offsets, _ = fold.folder().fold([a, b])
    h = fold.poly_hashes(codes, offsets)
    assert (h[0, 0] == h[0, 1] and h[1, 0] == h[1, 1]) == same


def test_hash_does_not_depend_on_batch(spark):
    random.seed(0)
    texts = ["".join(random.choices("가나abc .,", k=random.randrange(30))) for _ in range(50)]
    whole = fold.poly_hashes(*fold.folder().fold(texts)[:2])
    for i, t in enumerate(texts):
        assert np.array_equal(fold.poly_hashes(*fold.folder().fold([t])[:2])[:, 0], whole[:, i])


def test_whole_small_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pair_registry.parquet")
    rows = [tuple(r) for r in d.select("pair_id", "ko_text_analysis", "en_text_analysis").collect()]
    assert sorted((r.keep_pair_id, r.copy_pair_id) for r in copies.format_copies(d).collect()) == brute(rows)


@pytest.mark.parametrize("t", ["", None, "   ", "​"])
def test_texts_without_letters_fold_to_nothing(t):
    assert len(fold.folder().fold([t])[0]) == 0


