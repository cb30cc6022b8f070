from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import overlap
from pairloom.llm.words import edits, near, words

SCHEMA = "pair_id string, ko_text_analysis string, en_text_analysis string, is_validation_upstream boolean"
KO = "봄 로비에서 로주미마을이 1086원 다양한 인형을 빨리 노래했습니다"
EN = "Rojumi Village sang about the various doll for 1086 won quickly at the lobby in spring"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    out = set()
    for k1, a1, b1, v1 in rows:
        for k2, a2, b2, v2 in rows:
            if k1 is not None and k2 is not None and v1 and not v2:
                p, q, r, s = map(words, (a1, b1, a2, b2))
                if near(p, r) and near(q, s) or near(p, s) and near(q, r):
                    out.add((min(k1, k2), max(k1, k2)))
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    return sorted((r.pair_id_a, r.pair_id_b) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, schema)).collect())


def test_kinds_of_overlap(spark):
    rows = [
        ("v", KO, EN, True), ("same", KO, EN, False), ("format", KO.replace(" ", "  ") + ".", EN.upper(), False), ("swapped", EN, KO, False),
        ("one_word", KO.replace("빨리", "천천히"), EN, False), ("dropped", KO, EN.replace(" quickly", ""), False), ("added", KO, EN + " today", False),
        ("both", KO.replace("빨리", "천천히"), EN.replace("quickly", "slowly"), False), ("joined", KO.replace("로비에서 로주미", "로비에서로주미"), EN.replace("doll", "car"), False),
        ("three_of_eight", "봄 창고에서 로주미마을이 1086원 다양한 인형을 천천히 요리했습니다", EN, False), ("other", "전혀 다른 문장 하나 여기에 있습니다", "an entirely different sentence stands here", False), ("also_val", KO, EN, True),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    partners = {a if b == "v" else b for a, b in got if "v" in (a, b)}
    assert partners == {"same", "format", "swapped", "one_word", "dropped", "added", "both", "joined"}


def test_short_texts_need_equality(spark):
    rows = [("v", "네", "Yes", True), ("t", "네.", "yes", False), ("u", "아니", "yes", False), ("w", "a b c d e", "1 2 3 4 5", True), ("x", "a b c d f", "1 2 3 4 5", False)]
    assert found(spark, rows) == brute(rows) == [("t", "v")]


def test_nulls_empty_repeats_and_clashes(spark):
    rows = [("a", None, None, True), ("b", "", "", None), (None, KO, EN, True), ("c", KO, EN, None), ("d", "x " * 20_000, "y " * 20_000, True), ("e", "x " * 20_000, "y " * 19_999, False)]
    assert found(spark, rows) == [("a", "b"), ("d", "e")]
    assert found(spark, []) == []
    d = spark.createDataFrame([("a", KO, EN, True, 1, 2), ("b", KO, EN, False, 1, 2)], SCHEMA + ", key_hi int, sig int")
    assert overlap.cross_split_pairs(d).count() == 1


def test_one_side_shared_by_a_third_of_all_rows(spark):
    """A hot side meets only together with the other side."""
    d = spark.range(3000).select(
        F.format_string("k%05d", "id").alias("pair_id"), F.when(F.col("id") % 3 == 0, "네 알겠습니다 감사합니다 안녕히 가세요 또 뵙겠습니다").otherwise(F.format_string("문장 %d 번째 것은 서로 다른 말입니다", "id")).alias("ko_text_analysis"),
        F.format_string("word%d thing%d item%d is number %d here", (F.col("id") / 2).cast("int"), (F.col("id") / 2).cast("int"), (F.col("id") / 2).cast("int"), (F.col("id") / 2).cast("int")).alias("en_text_analysis"), (F.col("id") % 2 == 0).alias("is_validation_upstream"),
    )
    rows = [tuple(r) for r in d.collect()]
    got = sorted((r.pair_id_a, r.pair_id_b) for r in overlap.cross_split_pairs(d).collect())
    want = [(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if near(words(a[1]), words(b[1])) and near(words(a[2]), words(b[2]))]
    assert set(want) <= set(got)


def test_no_link_is_lost_on_random_edits(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        a, b = ([random.choice(vocabulary) for _ in range(random.randrange(6, 26))] for _ in range(2))
        rows.append((f"v{i}", "가" + " ".join(a), " ".join(b), True))
        for j in range(3):
            p, q = list(a), list(b)
            for side in (p, q):
                for _ in range(random.randrange(0, len(side) // 6 + 1)):
                    at = random.randrange(len(side))
                    random.choice((lambda: side.pop(at), lambda: side.insert(at, random.choice(vocabulary)), lambda: side.__setitem__(at, "새말")))()
            rows.append((f"t{i}_{j}", "가" + " ".join(p), " ".join(q), False))
    assert found(spark, rows) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9), st.integers(0, 9))
def test_edits_of_words_that_do_not_join(a, b, most):
    a, b = [x * 3 + "1" for x in a], [x * 3 + "1" for x in b]
    want = levenshtein(a, b)
    assert edits(a, b, most) == min(want, most + 1) or edits(a, b, most) < want and "".join(a) != "".join(b)


def test_no_link_is_lost_on_codes_and_respacing(spark):
    """Words of letters and digits, joined and parted anywhere, changed at random; sides exchanged at times."""
    random.seed(11)
    word = lambda: "".join(random.choices("abc123", k=random.choice((1, 2, 3, 5, 10))))
    rows = []
    for i in range(70):
        a, b = ([word() for _ in range(random.randrange(1, 27))] for _ in range(2))
        rows.append((f"v{i}", "가 " * (i % 3) + " ".join(a), " ".join(b), True))
        for j in range(4):
            sides = []
            for side in (a, b):
                p = list(side)
                for _ in range(random.randrange(0, len(side) // 6 + 1)):
                    at = random.randrange(len(p))
                    random.choice((lambda: p.pop(at), lambda: p.insert(at, word()), lambda: p.__setitem__(at, random.choice((word(), "새말")))))()
                blank = random.choice((0.0, 0.3, 0.6, 1.0))
                spaced = "".join(w + ("" if random.random() < blank else " ") for w in p).strip()
                if random.random() < 0.2:
                    spaced = "".join(c + (" " if random.random() < 0.4 else "") for c in spaced)
                sides.append(spaced)
            sides[0] = "가 " * (i % 3) + sides[0]
            rows.append((f"t{i}_{j}", *(sides[::-1] if random.random() < 0.2 else sides), False))
    want = brute(rows)
    assert len(want) > 150 and found(spark, rows) == want


@pytest.mark.parametrize("others", [20, 120])
def test_links_do_not_depend_on_unrelated_records(spark, others):
    """Stock sentences in many records of both splits, beside near sides whose changed words are long or respaced."""
    stock = "please see the attached list of parts and confirm the order today"
    rows = [
        ("v0", "서울 공장 a1b2c3d4e5 부품을 조립 했다", stock, True), ("t0", "서울 공장 q9w8x7y6z5 부품을 조립 했다", stock, False),
        ("v1", "부산 창고 k1l2m3n4o5 상자를 운반 했다", stock, True), ("t1", "부산창고 z1y2x3w4v5 상자를운반 했다", stock, False),
        *((f"{'vt'[i % 2]}x{i}", f"{i}번째 다른 문장 {i * 7} 입니다 여기 {i * 13}", stock, i % 2 == 0) for i in range(others)),
    ]
    got = found(spark, rows)
    assert {("t0", "v0"), ("t1", "v1")} <= set(got) and got == brute(rows)
    codes = [("v", "서울 공장 x1y2z3w4v5 부품을 조립 했다", "the plant k1l2m3n4o5 part was assembled", True), ("t", "서울 공장 a9b8c7d6e5 부품을 조립 했다", "the plant p1q2r3s4t5 part was assembled", False)]
    assert found(spark, codes) == [("t", "v")]


def test_beginning_and_end_keep_every_near_text():
    """Any text with one change of one word, joined anywhere, shares a hash of both ends with the finer one; with more changes all meet."""
    random.seed(2)
    word = lambda: "".join(random.choices("abcd", k=random.choice((1, 2, 4, 9))))
    for _ in range(400):
        a = [word() for _ in range(random.randrange(1, 15))]
        b = list(a)
        if len(a) > 5:
            random.choice((lambda: b.pop(random.randrange(len(b))), lambda: b.__setitem__(random.randrange(len(b)), word()), lambda: b.insert(random.randrange(len(b)), word())))()
        b = "".join(w + random.choice(("", " ")) for w in b).split()
        if not near(a, b):
            continue
        fine, coarse = (a, b) if len(a) >= len(b) else (b, a)
        for f, c in ((overlap._fine_ends, overlap._coarse_ends), (overlap._fine, overlap._coarse)):
            (_, keys), used = f([" ".join(fine)], 6)
            assert set(keys.tolist()) & set(c([" ".join(coarse)], used)[1].tolist())


@pytest.mark.parametrize("hot", [1, 3, 32])
def test_links_do_not_depend_on_what_counts_as_hot(spark, sf_dir, monkeypatch, hot):
    d = spark.read.parquet(f"{sf_dir}/pair_registry.parquet").select("pair_id", "ko_text_analysis", "en_text_analysis", "is_validation_upstream")
    template = [(f"{'vt'[i % 2]}{i:03d}", f"안녕하세요 고객님 저희 상점을 이용해 주셔서 감사합니다 주문 {i // 2}{i // 2} 번", f"hello dear customer thank you for using our shop your order is {i // 2}x{i // 2} today", i % 2 == 0) for i in range(90)]
    d = d.unionByName(spark.createDataFrame(template, SCHEMA))
    monkeypatch.setattr(overlap, "HOT", hot)
    got = sorted((r.pair_id_a, r.pair_id_b) for r in overlap.cross_split_pairs(d).collect())
    assert got == brute([tuple(r) for r in d.collect()])


def test_hot_on_both_sides_and_by_halves(spark):
    """Stock beginnings on both sides in hundreds of records: only the true pairs come out."""
    rows = [(f"{'vt'[i % 2]}{i:03d}", f"안녕하세요 고객님 저희 상점을 이용해 주셔서 감사합니다 주문 {i // 2}{i // 2} 번", f"hello dear customer thank you for using our shop your order is {i // 2}x{i // 2}", i % 2 == 0) for i in range(160)]
    rows = [(k, a + (f" 끝 {i}" if i % 8 == 3 else ""), b, v) for i, (k, a, b, v) in enumerate(rows)]
    assert found(spark, rows) == brute(rows)


def test_joined_words_cost_nothing():
    assert edits("가 나 다 라".split(), "가나 다 라".split(), 3) == 0
    assert edits("가 나 다 라 마".split(), "가나 다 바 마".split(), 3) == 1


def test_report(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pair_registry.parquet")
    pairs = overlap.cross_split_pairs(d)
    r = overlap.overlap_report(d).agg(F.sum("exact_pairs").alias("e"), F.sum("near_pairs").alias("n"), F.sum("records").alias("r")).first()
    assert (r.e or 0) + (r.n or 0) == 2 * pairs.count()
    assert r.r == pairs.select(F.explode(F.array("pair_id_a", "pair_id_b"))).distinct().count()
    rows = [tuple(x) for x in d.select("pair_id", "ko_text_analysis", "en_text_analysis", "is_validation_upstream").collect()]
    assert sorted((x.pair_id_a, x.pair_id_b) for x in pairs.collect()) == brute(rows)


def by_definition(a, b):
    """Edits over all pairs of places: a stretch of at most one word of each text goes, from and to an end of a word of either."""
    x, y = "".join(a), "".join(b)
    cut_x, cut_y = ({sum(map(len, ws[:k])) for k in range(len(ws) + 1)} for ws in (a, b))
    best = {(0, 0): 0}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if (v := best.get((i, j))) is None:
                continue
            if i < len(x) and j < len(y) and x[i] == y[j]:
                best[i + 1, j + 1] = min(v, best.get((i + 1, j + 1), v))
            if i in cut_x or j in cut_y:
                for p in range(i, min([c for c in cut_x if c > i], default=i) + 1):
                    for q in range(j, min([c for c in cut_y if c > j], default=j) + 1):
                        if (p, q) != (i, j) and (p in cut_x or q in cut_y):
                            best[p, q] = min(v + 1, best.get((p, q), v + 1))
    return best[len(x), len(y)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), max_size=5))
def test_edits_by_definition(a, b):
    assert edits(a, b, 9) == edits(b, a, 9) == min(by_definition(a, b), 10)


def test_any_number_of_words_may_be_joined():
    whole = words("작년 후소서군 가게 증폭기가 910미터 재미있는 창구를 구입했습니까")
    assert edits(whole, words("작년후소서군 증폭기가910미터재미있는창구를구입했습니까"), 3) == 1  # a word dropped, five joined
    assert edits(whole, words("작년후소서군시장증폭기가910미터재미있는창구를구입했습니까"), 3) == 1  # a word replaced inside eight
    assert edits(whole, words("작년후소서군시장증폭기가910미터재미있는창문을구입했습니까"), 3) == 2


def test_joined_record_with_a_dropped_word_is_found(spark):
    en = "Did Husoseo County purchase the amusing window 910 meters from the amplifier shop last year"
    rows = [("v", "작년 후소서군 가게 증폭기가 910미터 재미있는 창구를 구입했습니까", en, True), ("t", "작년후소서군 증폭기가910미터재미있는창구를구입했습니까", en, False)]
    assert found(spark, rows) == [("t", "v")]
