from __future__ import annotations

from pairloom.llm import garble as g

CLEAN = ["카페에서 마을이 자전거를 청소했습니다.", "우리는 카페에서 의자를 구입했어요.", "마을이 의자를 구입했습니다 정말로.", "The café team “visited” us.", "A naïve résumé – fine.", "AÇÃO and coração stay.", "화력(火力) 그리고 слово", "plain ascii text", "마을이 카페에서 자전거를 구입했어요"]


def table(spark, texts):
    return spark.createDataFrame([(f"p{i}", t, "plain") for i, t in enumerate(texts)], "pair_id string, ko_text_analysis string, en_text_analysis string")


def test_every_chain_is_found_and_no_clean_text(spark):
    originals = ("카페에서 마을이 자전거를 청소했습니다.", "우리는 카페에서 의자를 구입했어요.", "The café team “visited” us.")
    wrong = [x for c in g.CHAINS for t in originals if (x := g.garbled(t, c)) and g.NON_ASCII.search(x)]
    # With a chain that UTF-8 undoes, the clean text itself comes out.
    wrong = [x for x in dict.fromkeys(wrong) if x not in originals]
    got = {int(r.pair_id[1:]) for r in g.garbled_sides(table(spark, CLEAN * 3 + wrong)).collect()}
    first = 3 * len(CLEAN)
    assert not [i for i in got if i < first]
    missed = [wrong[i - first] for i in range(first, first + len(wrong)) if i not in got]
    assert not missed, missed


def test_clean_texts_are_no_cases(spark):
    assert g.garbled_sides(table(spark, CLEAN)).count() == 0


def test_stretches_and_unknown_names(spark):
    texts = [*CLEAN, "어제 " + g.garbled("카페에서", g.CHAINS[1]) + " 놀았다", g.garbled("빛노두재단은 카펫", g.CHAINS[0]), "We met at the caf� today"]
    got = {r.pair_id for r in g.garbled_sides(table(spark, texts)).collect()}
    assert got == {f"p{len(CLEAN) + i}" for i in range(3)}


def test_repair_is_verified(spark):
    original = "카페에서 마을이 12,345원 자전거를 청소했습니다."
    texts = [*CLEAN, *(g.garbled(original, g.CHAINS[i]) for i in (0, 1, 2))]
    got = {r.pair_id: r for r in g.repaired_sides(table(spark, texts)).collect()}
    assert len(got) == 3
    for r in got.values():
        assert r.restored_text == original and r.complete and " read as " in r.chain


def test_nulls_empty_long_and_clashes(spark):
    d = spark.createDataFrame([("a", None, "", 1), (None, g.garbled("카페에서 마을이", g.CHAINS[0]), "x", 1), ("c", ("카페에서 " * 30_000) + g.garbled("카페에서", g.CHAINS[0]), None, 1), ("c2", "카페에서", "x", 1)], "pair_id string, ko_text_analysis string, en_text_analysis string, unit int")
    assert [tuple(r) for r in g.garbled_sides(d).collect()] == [("c", "ko")]
    assert g.garbled_sides(d.limit(0)).count() == 0 and g.repaired_sides(d.limit(0)).count() == 0


def test_round_trip_of_chains():
    for chain in g.CHAINS:
        x = g.garbled("카페에서 café", chain) or g.garbled("카페에서", chain)
        if x and "�" not in x and (back := g.restored(x, chain)):
            assert g.garbled(back, chain) == x
    assert g.restored("��", g.CHAINS[0]) is None


def test_copies_of_a_garbled_record_and_commoner_forms(spark):
    chains = {" > ".join(f"{w} {r}" for w, r in c): c for c in g.CHAINS}
    hot = g.garbled("café", chains["cp1252 mac_roman"])  # one clean "café" only
    hanja = [g.garbled(x, chains["cp949 gb18030"]) for x in ("의자를", "마을이")]
    # Copies count once, however spaced; two forms of one chain in a text need no frequency.
    texts = [*CLEAN, *[f"We met at the {hot} today"] * 5, f"We  met at the {hot}, today.", *(f"{hanja[0]} {hanja[1]} {i}번" for i in range(6))]
    got = {int(r.pair_id[1:]) for r in g.garbled_sides(table(spark, texts)).collect()}
    assert got == set(range(len(CLEAN), len(texts)))
    restored = {r.restored_text for r in g.repaired_sides(table(spark, texts)).collect()}
    assert "We met at the café today" in restored and "의자를 마을이 0번" in restored


def test_a_common_word_that_is_also_a_form_is_no_case(spark):
    word = g.garbled("의자를", next(c for c in g.CHAINS if c == (("cp949", "gb18030"),)))
    assert g.clean(word)
    assert g.garbled_sides(table(spark, [*CLEAN, *(f"{word} {'가나다라마바'[i]} 번" for i in range(6))])).count() == 0
