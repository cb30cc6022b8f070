"""Token budgets, packing, leaks and reading levels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions.tokenizer import vocabulary_path
from pairloom.llm import leak, packing, reading, tokens

VOCABULARY = vocabulary_path()


@pytest.fixture(scope="module")
def encode():
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(st.sampled_from("ab cde\n't123가나다 "), max_size=80), max_size=6))
def test_counts_equal_the_tokenizer(encode, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tokens.counter(VOCABULARY).tokens(texts) == [len(encode(t)) for t in texts]


def test_state_is_carried_along_prefixes(encode):
    c = tokens.Counter(VOCABULARY)
    pieces = sorted(p.encode() for p in ("in", "inter", "internal", "internationalization", "interoperability", "가나다", "가나다라마", "가"))
    assert list(c.walk(pieces)) == [len(encode(p.decode())) for p in pieces]


def test_whole_documents(spark, sf_dir, encode):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: len(encode(r.text)) for r in d.collect()}
    assert {r.doc_id: r.tokens for r in tokens.with_tokens(d, "text").collect()} == want


def test_budget_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, domain string, tokens int"
    rows = [(1, "hello there", "Some Source", "a", 9), (1, "hello there", "Some Source", "a", 9), (2, None, "some source", None, 9), (3, "안녕하세요", "SomeSource.", "a", 9), (4, "", None, "a", 9), (None, "x", "s", "a", 9), (5, "x y " * 50_000, "SomeSource.", "a", 9), (6, "12", "SomeSource.", "a", 9)]
    got = {(r.source, r.language, r.domain): (r.n_texts, r.tokens) for r in tokens.document_budget(spark.createDataFrame(rows, schema)).collect()}
    assert sum(n for n, _ in got.values()) == 6 and got[None, "und", "a"] == (1, 0) and got["SomeSource.", "und", None] == (1, 0)
    assert {s for s, _, _ in got} == {"SomeSource.", None}
    assert tokens.document_budget(spark.createDataFrame([], schema)).count() == 0


def test_pair_budget_takes_the_latest_and_counts_lists(spark):
    m = spark.createDataFrame([("a", 1, [1, 2], [1]), ("a", 2, [1, 2, 3], None), ("a", 2, [1, 2, 3], None), ("b", 1, [], [5]), (None, 1, [1], [1]), ("zz", 1, [1], [1])], "pair_id string, measured_at int, ko_token_ids array<int>, en_token_ids array<int>")
    p = spark.createDataFrame([("a", "025", "d"), ("b", "025", None)], "pair_id string, logical_corpus string, domain string")
    got = {(r.domain, r.language): (r.n_texts, r.tokens) for r in tokens.pair_budget(m, p).collect()}
    assert got == {("d", "ko"): (1, 3), ("d", "en"): (0, 0), (None, "ko"): (1, 0), (None, "en"): (1, 1)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_never_overfills_and_places_all(sizes):
    w = packing.pack(np.array(sizes, int), 100)
    assert len(w) == len(sizes)
    if sizes:
        assert np.bincount(w, sizes).max() <= 100 and w.min() >= 0


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 900, 2000))[::-1]
    w = packing.pack(sizes, 2048)
    assert (w.max() + 1) * 2048 <= 1.04 * sizes.sum() + 2048


def test_containers_of_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, ""), (900002, None), (None, "x"), (900003, "word " * 9000), (900003, "word " * 9000)], "doc_id long, text string")
    got = packing.containers(d.unionByName(extra).withColumn("container", F.lit("clash"))).collect()
    want = {r.doc_id: r.tokens for r in tokens.with_tokens(d.unionByName(extra).where("doc_id is not null").distinct(), "text").collect()}
    by_doc: dict = {}
    load: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert set(by_doc) == set(want) and max(load.values()) <= packing.CAPACITY
    for k, pieces in by_doc.items():
        at = 0
        for first, n in sorted(pieces):
            assert first == at
            at += n
        assert at == want[k]
        assert len(pieces) == 1 or want[k] > packing.CAPACITY
    assert packing.containers(d.limit(0)).count() == 0


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew some strange potions"
KO_ITEM = "어제 빨간 여우가 게으른 개를 뛰어넘고 마법사 일곱 명이 조용히 이상한 약을 끓였다"


def leaks(spark, docs, items=None, edits=0):
    items = items or [(1, ITEM, "en"), (2, KO_ITEM, "ko")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_text string, lang string")
    return sorted((r.item_id, r.doc_id) for r in leak.leaked_items(d, i, edits).collect())


def test_leaks_of_all_kinds(spark):
    w, k = ITEM.split(), KO_ITEM.split()
    docs = [
        (1, "start " + " ".join(w[2:14]) + " end"), (2, " ".join(w[2:13])), (3, "X " + " ".join(w).upper().replace(" ", ", ")), (4, "앞말 " + " ".join(k[1:9]) + " 뒷말"), (5, " ".join(k[1:8])), (6, "앞 " + "".join(k) + " 뒤"),
        (7, " ".join(w).replace("o", "о")), (8, " ".join(w[:6]) + " other " + " ".join(w[6:12])), (9, ""), (10, " ".join(w[:12]) + "s extra"), (11, "prefix " + " ".join(w[:12])),
    ]
    assert leaks(spark, docs) == [(1, 1), (1, 3), (1, 7), (1, 11), (2, 4), (2, 6)]


def test_leaks_with_an_edit_budget(spark):
    w = ITEM.split()
    docs = [(1, "aa " + " ".join(w[2:14]).replace("lazy", "lezy") + " zz"), (2, "aa bb cc")]
    assert leaks(spark, docs) == [] and leaks(spark, docs, edits=1) == [(1, 1)]


def test_exact_passages_are_those_without_edits(spark):
    w = ITEM.split()
    docs = [(1, "aa " + " ".join(w[2:14]) + " zz"), (2, "aa " + " ".join(w[2:14]).replace("lazy", "lezy") + " zz"), (3, " ".join(w[:12]) + "s extra"), (4, "aa " + " ".join(w[2:14]).replace("lazy", "lazzy") + " zz"), (5, " ".join(w[:11]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM, "en")], "item_id long, item_text string, lang string")
    got = {r.doc_id: (r.words >= 12, r.edits) for r in leak.leaked_items(d, i, 1).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 1), 4: (False, 1)}


def test_short_passages_leak_too(spark):
    items = [(1, "1 2 3 4 5 6 7 8 9 값은", "ko"), (2, "a b c d e f g h i j k l m", "en")]
    docs = [(1, "여기 1 2 3 4 5 6 7 8 끝"), (2, "x b c d e f g h i j k l m y"), (3, "1 2 3 4 5 6 7")]
    assert leaks(spark, docs, items) == [(1, 1), (2, 2)] == [x for x in leaks(spark, docs, items, 1) if x != (1, 3)]


def test_repetitive_texts_in_bounded_memory(spark, monkeypatch):
    word = [(1, "가나다 " * 400, "ko"), (2, "ha ho " * 200, "en")]
    docs = [(1, "가나다 " * 60_000), (2, "가나다 " * 7 + "끝"), (3, "ho ha " * 60_000), (4, ("가나다 " * 7 + "라 ") * 2_000)]
    index = leak.Index(word, 0)
    assert all(len(i.places) < 100 for i in index.items)
    assert leaks(spark, docs, word) == [(1, 1), (2, 3)]
    monkeypatch.setattr(leak, "SLICE", 1000)
    codes, offsets, _ = leak.folder().fold(["가나다 " * 3000])
    one = np.ones(len(codes), bool)
    assert [(t, i) for t, i, _, _ in leak.scan(index, codes, offsets, one, one)] == [(0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=4, max_size=10), st.lists(st.integers(0, 2), max_size=14), st.integers(0, 5), st.integers(0, 3), st.integers(1, 3))
def test_banded_distance_by_definition(needle, hay, first, wide, most):
    """Edits to any stretch of the hay that begins in the band, computed over the whole hay; alignments leave the band by no more than the budget."""
    got = leak.banded_distance(np.array(needle), np.array(hay, int), first, first + wide, most)
    best = most + 1
    for start in range(first, min(first + wide, len(hay)) + 1):
        row = list(range(len(hay) - start + 1))
        row = [x if x else 0 for x in row]
        for i, c in enumerate(needle, 1):
            new = [i]
            for j in range(1, len(hay) - start + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != hay[start + j - 1])))
            row = new
        best = min(best, *row)
    assert got == min(best, most + 1)


def test_leaks_in_odd_tables(spark):
    assert leaks(spark, []) == [] and leaks(spark, [(1, None), (None, ITEM)]) == []
    assert leaks(spark, [(1, ITEM)], [(1, None, "en"), (None, ITEM, "en"), (3, "too short", "en"), (4, ITEM, None)]) == [(4, 1)]
    assert leaks(spark, [(1, ITEM), (1, ITEM)]) == [(1, 1)]
    long = "filler words here " * 80_000
    assert leaks(spark, [(1, long + ITEM + " " + long)]) == [(1, 1)]


def test_items_in_blocks_give_the_same(spark, sf_dir, monkeypatch):
    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    long = spark.createDataFrame([(-1, "filler words here " * 80_000 + i.where("lang = 'en'").first().item_text + " more " * 9)], "doc_id long, text string")
    d = d.select("doc_id", "text").unionByName(long)
    one = {e: sorted(tuple(r) for r in leak.leaked_items(d, i, e).collect()) for e in (0, 1)}
    monkeypatch.setattr(leak, "BLOCK_CODES", 1000)
    assert {e: sorted(tuple(r) for r in leak.leaked_items(d, i, e).collect()) for e in (0, 1)} == one and len(one[0]) > 4


def test_leaks_equal_word_windows(spark, sf_dir):
    from pairloom.llm.words import words

    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    grams: dict = {}
    for r in i.collect():
        w, k = words(r.item_text), leak.WORDS[r.lang]
        for a in range(len(w) - k + 1):
            grams.setdefault(tuple(w[a : a + k]), set()).add(r.item_id)
    texts = {r.doc_id: words(r.text) for r in d.collect()}
    want = {(x, n) for n, w in texts.items() for k in (8, 12) for a in range(len(w)) for x in grams.get(tuple(w[a : a + k]), ())}
    assert {(r.item_id, r.doc_id) for r in leak.leaked_items(d, i).collect()} == want


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = np.where(x[:, 0] > 0, 3.0, 1.0) + x[:, 1] ** 2
    model = reading.Boosted().fit(x[:600], y[:600])
    error = np.abs(model.predict(x[600:]) - y[600:]).mean()
    assert error < 0.5 * np.abs(y[600:] - y[:600].mean()).mean()
    a, b = reading.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert list(b) == sorted(b) and len(a) == len(b)


def test_levels_of_simple_and_hard_texts(spark):
    random.seed(2)
    easy, hard = "cat dog sun hat run big".split(), "epistemology jurisprudence thermodynamics heterogeneous stipulation".split()
    docs, labels = [], []
    for i in range(240):
        level = i % 6 + 1
        words = [random.choice(hard if random.random() < level / 7 else easy) for _ in range(60)]
        docs.append((i, " ".join(" ".join(words[k : k + 3 * level]) + "." for k in range(0, 60, 3 * level)), f"s{i % 7}", "d"))
        if i < 180:
            labels += [(i, "r1", level), (i, "r1", level), (i, "r2", min(6, level + 1)), (i, "r3", None)]
    docs += [(1000, "", "s1", "d"), (1001, None, "s1", "d"), (1002, "안녕하세요 한국어", "s1", None), (1003, "12 34", None, "d"), (None, "x", "s1", "d"), (239, docs[239][1], "s1", "d")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, domain string").withColumn("score", F.lit("clash"))
    t = reading.train(d, spark.createDataFrame(labels, "doc_id long, rater string, reading_level int"))
    got = {r.doc_id: r for r in reading.reading_levels(d, t).collect()}
    assert len(got) == 244
    assert np.mean([abs(got[i].reading_level - (i % 6 + 1.5)) for i in range(180, 240)]) < 1.0
    assert got[1000].reading_level is None and got[1001].reading_level is None and got[1003].language is None and got[1002].reading_level is None
    report = reading.held_out_report(t).agg(F.sum("rated").alias("n"), F.avg("mean_error").alias("e")).first()
    assert report.n == 180 and report.e < 1.2
    profile = reading.level_profile(d, reading.reading_levels(d, t))
    assert profile.agg(F.sum("documents")).first()[0] == 244


def test_reading_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "some text", "s", "d")], "doc_id long, text string, source string, domain string")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    assert [(r.doc_id, r.reading_level) for r in reading.reading_levels(d, reading.train(d, none)).collect()] == [(1, None)]
    assert reading.reading_levels(d.limit(0), reading.train(d.limit(0), none)).count() == 0


def test_leaks_across_the_border_of_what_is_read_at_once(spark):
    """Around the border there is no blank, or nothing but blanks."""
    at = leak.SEGMENT - len(ITEM) // 2
    docs = [(1, "가" * at + "." + ITEM.replace(" ", "") + "." + "나" * 3000), (2, "가" * (at - 10_000) + "\n" + ITEM.replace(" ", " " * 2_000) + " 끝"), (3, "가" * at + ITEM.replace(" ", "") + "나" * 3000)]
    assert leaks(spark, docs) == [(1, 1), (1, 2)]


def test_stretches_are_the_whole_text(monkeypatch):
    text = "가나 다, abc.de  fg\n\n   h" * 9
    codes, offsets, origin = leak.folder().fold([text])
    apart = np.concatenate([[True], np.diff(origin) > 1, [True]])
    for size in (3, 7, 50, 1000):
        monkeypatch.setattr(leak, "SEGMENT", size)
        done = 0
        for got, begun, ended in leak._stretches(text, 12):
            new = len(got) - min(12, done)
            at = done + new - len(got)
            done += new
            assert np.array_equal(got, codes[at:done]) and np.array_equal(begun, apart[at:done])
            assert np.array_equal(ended[:-1], apart[at + 1 : done]) and (not len(ended) or ended[-1] <= apart[done])
        assert done == len(codes)
