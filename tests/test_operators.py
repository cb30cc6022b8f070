from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import aggregate as ag
from pairloom.operators import inference as inf
from pairloom.operators import models as ml
from pairloom.operators import ranks as rk
from pairloom.operators import relations as rl
from pairloom.operators import sampling as sm
from pairloom.operators import validate as va


def test_overlap_matrix_equals_sets(spark, as_rows):
    random.seed(1)
    data = [(random.choice("abc"), f"d{random.randrange(12)}") for _ in range(80)] + [(None, "d1"), ("a", None)]
    got = {(r.dim_a, r.dim_b): r for r in rl.overlap_matrix(spark.createDataFrame(data, "c string, d string"), "c", "d").collect()}
    sets = {k: {d for c, d in data if c == k and d} for k in "abc"}
    for a in "abc":
        n = sum(c == a for c, _ in data)
        assert (got[a, a].rows_a, got[a, a].distinct_a) == (n, len(sets[a]))
        for b in "abc":
            if a < b and sets[a] & sets[b]:
                assert got[a, b].shared_distinct == len(sets[a] & sets[b])


def test_matchable_and_mechanism(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",)] * 2 + [("z",), (None,)], "k string")
    assert rl.matchable(a, b, "k").first().matchable == 2
    assert rl.matchable(a.limit(0), b, "k").first().matchable == 0
    d = spark.createDataFrame([("g", "A"), ("g", "A"), ("g", "B"), ("h", "B")], "d string, c string")
    assert tuple(rl.mechanism(d, "d", "c", ("A", "B")).first()) == (1, 0, 1, 1)


def test_group_resolution_ignores_nulls(spark):
    cols = "duplicate_group_id string, pair_id string, translation_direction_raw string, domain string, source_id string, source_provenance_raw string, translation_direction_review_flag boolean"
    d = spark.createDataFrame([("g", "b", None, "x", "s", None, None), ("g", "a", "KO", "x", "t", None, False), ("h", "c", "KO", "x", "s", "p", False), ("h", "d", "EN", "y", "s", "p", False)], cols)
    got = {r.duplicate_group_id: r for r in rl.group_resolved(d).collect()}
    assert not got["g"].direction_conflict_flag and got["g"].source_id_conflict_flag and got["g"].representative_pair_id == "a"
    assert got["h"].direction_conflict_flag and got["h"].domain_conflict_flag
    full = {r.pair_id: r for r in rl.resolved_registry(d).collect()}
    assert full["b"].translation_direction == "KO" and full["c"].translation_direction == "UNKNOWN" and full["c"].translation_direction_review_flag


def test_latest_rows_and_seen_before(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 2, 4), ("b", 1, None), (None, 9, 9)], "k string, t int, v int")
    assert {tuple(r) for r in rl.latest_rows(d, "k", "t", ["v"]).collect()} == {("a", 2, 4), ("b", 1, None)}
    s = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4), (None, 5)], "d string, o int")
    assert {(r.o, r.seen_before) for r in rl.seen_before(s, "d", ["o"]).collect()} == {(1, False), (2, True), (3, False), (4, False), (5, True)}


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, None, None)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "z", 1), (3, None, 5), (4, "w", 1)], "k int, s string, n int")
    assert {tuple(r) for r in rl.differing_rows(a, b, "k", ["s", "n"]).collect()} == {(2, True, False), (3, False, True)}
    assert {(r.side, r.n) for r in rl.key_difference(a, b, "k").collect()} == {("left_only", 0), ("right_only", 1)}


def test_spine_join_drops_clashing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "other", 2)], "k int, v string, w int")
    assert rl.spine_join(a, [b], "k").first().asDict() == {"k": 1, "v": "x", "w": 2}


def test_ranks_both_ways(spark):
    random.seed(3)
    x = [random.choice([1.0, 2.0, 2.5, 7.0, 9.0, -1.0]) for _ in range(200)]
    d = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    want = {v: statistics.mean(i + 1 for i, y in enumerate(sorted(x)) if y == v) for v in set(x)}
    assert {r.value: r["rank"] for r in ag.average_ranks(d, "x").collect()} == pytest.approx(want)
    assert {r.value: r["rank"] for r in ag.average_ranks(d, "x", parts=5).collect()} == pytest.approx(want)
    assert ag.average_ranks(d.limit(0), "x").count() == 0


def test_describe_histogram_entropy(spark):
    d = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,), (float("nan"),)], "x double")
    r = ag.describe(d, ["x"]).first()
    assert (r.n, r.p50, r.iqr, r.upper_fence) == (101, 50.0, 50.0, 150.0)
    assert {h.bin: h.n for h in ag.histogram(d.where("not isnan(x)"), "x", 10.0, 10.0, 3).collect()} == {0: 20, 1: 10, 2: 71}
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x"), ("b", "x")], "p string, q string")
    assert {r.dimension: r.entropy for r in ag.entropy(e, ["p", "q"]).collect()} == {"p": 1.0, "q": 0.0}
    assert ag.describe(d.limit(0), ["x"]).count() == 0


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, 300), rng.integers(0, 20, 300)
    y = y + x
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    d = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    assert ag.spearman(d, "x", "y").first().rho == pytest.approx(want)


def test_greedy_sample_is_disjoint_and_reproducible(spark):
    d = spark.createDataFrame([(f"k{i:03d}", i % 5, float(i)) for i in range(200)], "k string, g int, v double")
    groups = [("zero", F.col("g") == 0, []), ("top", F.lit(True), [F.desc("v")])]
    a = {tuple(r) for r in sm.greedy_groups(d, "k", groups, 10, 30, "s").collect()}
    b = {tuple(r) for r in sm.greedy_groups(d.repartition(7), "k", groups, 10, 30, "s").collect()}
    assert a == b and len(a) == 30 and sum(c == "top" for _, c in a) == 10
    small = sm.greedy_groups(d.limit(4), "k", groups, 10, 30, "s")
    assert small.count() == 4
    assert sm.greedy_groups(d.limit(0), "k", groups, 10, 30, "s").count() == 0


def test_stratified_quota(spark):
    d = spark.createDataFrame([(f"k{i}", "hot" if i else "cold") for i in range(500)], "k string, s string")
    n = {r.s: r.n for r in sm.stratified(d, ["s"], "k", 7, "x").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert n == {"hot": 7, "cold": 1}


def test_artifact_checks(spark):
    d = spark.createDataFrame([("a",), ("b",)], "k string")
    fold = __import__("pairloom.functions.hashing", fromlist=["x"]).set_fingerprint(d, "k").first().fold
    assert va.assert_artifact(d, "k", rows=2, columns=1, fold=fold) is d
    for wrong in ({"rows": 3}, {"columns": 2}, {"fold": 1}):
        with pytest.raises(va.Violation):
            va.assert_artifact(d, "k", **wrong)
    with pytest.raises(va.Violation):
        va.assert_artifact(d.union(d), "k")


def test_completeness_and_identities(spark):
    d = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (0.0,)], "x double")
    assert tuple(va.completeness(d, ["x"], ["x"]).first()) == ("x", 1, 2, 1)
    e = va.identity_errors(d.where("x = 1"), {"same": (F.col("x"), F.lit(1.0)), "off": (F.col("x"), F.lit(3.0))})
    assert {tuple(r) for r in e.collect()} == {("same", 0.0), ("off", 2.0)}


def design(n=400, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - b + rng.normal(size=n) * (1 + np.abs(a))
    return np.column_stack([a, b, y])


def test_ols_hc1_and_bootstrap(spark):
    m = design()
    d = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(m)] + [(999, None, 1.0, 1.0, 1.0)], "k long, a double, b double, y double, c double")
    fit = ml.ols(ml.gram(d, ["a", "b", "c"], ["y"]), "y")
    assert fit.dropped == ["c"] and fit.rank == 3 and fit.n == 400
    x = np.column_stack([np.ones(400), m[:, :2]])
    want, *_ = np.linalg.lstsq(x, m[:, 2], rcond=None)
    assert fit.beta == pytest.approx(want)
    e = m[:, 2] - x @ want
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ (x.T @ (x * (e**2)[:, None])) @ inv) * 400 / 397)
    rows = ml.hc1(d, fit)
    assert [r["se"] for r in rows] == pytest.approx(se)
    draws = ml.wild_bootstrap(d, fit, "k", 200, 7)
    assert draws.std(axis=0) == pytest.approx(se, rel=0.25)
    assert np.array_equal(draws, ml.wild_bootstrap(d.repartition(5), fit, "k", 200, 7)) or np.allclose(draws, ml.wild_bootstrap(d.repartition(5), fit, "k", 200, 7))
    reduced = ml.ols(ml.gram(d, ["a"], ["y"]), "y")
    assert ml.nested(fit, reduced)["delta_r2"] > 0 and ml.nested(fit, reduced)["df"] == 1


def test_outcome_shift_identity(spark):
    m = design(seed=2)
    d = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, y double").withColumn("y2", F.col("y") - F.col("a"))
    g = ml.gram(d, ["a", "b"], ["y", "y2"])
    one, two = ml.ols(g, "y"), ml.ols(g, "y2")
    assert one.beta - two.beta == pytest.approx([0, 1, 0], abs=1e-9) and one.ssr == pytest.approx(two.ssr)


def test_subset_grams_huber_vif(spark):
    m = design(seed=4)
    m[0, 2] += 500
    d = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, y double")
    grams = ml.subset_grams(d, ["a", "b"], ["y"], {"all": F.lit(True), "positive": F.col("a") > 0})
    assert grams["all"].matrix == pytest.approx(ml.gram(d, ["a", "b"], ["y"]).matrix)
    assert grams["positive"].n == (m[:, 0] > 0).sum()
    robust = ml.huber(d, ["a", "b"], "y")
    assert robust["beta"] == pytest.approx([1, 2, -1], abs=0.4)
    vif = ml.collinearity(ml.gram(d, ["a", "b"], []))
    r2 = np.corrcoef(m[:, 0], m[:, 1])[0, 1] ** 2
    assert vif[0]["vif"] == pytest.approx(1 / (1 - r2))
    assert ml.gvif(ml.gram(d, ["a", "b"], []), ["a"]) == pytest.approx(1 / (1 - r2))


def test_signed_rank_against_enumeration(spark):
    x = [0.5, -1.0, 2.0, 2.0, 0.0, 3.0, -0.5, None]
    r = inf.signed_rank(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    assert (r.n, r.zeros, r.w_plus) == (6, 1, 1.5 + 4.5 + 4.5 + 6)
    assert inf.signed_rank(spark.createDataFrame([], "x double"), "x").count() == 1


def test_sign_p_and_interval(spark):
    assert inf.exact_sign_p(8, 2) == pytest.approx(0.109375)
    assert inf.exact_sign_p(0, 0) == 1.0
    d = spark.createDataFrame([(float(i),) for i in range(1, 102)], "x double")
    r = inf.order_statistic_interval(d, "x").first()
    assert r.median == 51 and r.low < 51 < r.high


def test_bootstrap_on_a_lattice_is_degenerate(spark):
    d = spark.createDataFrame([(4 / 3, "a")] * 900 + [(1.0, "b")] * 50 + [(2.0, "b")] * 50, "x double, s string")
    got = inf.median_bootstrap(d, "x", 300)
    assert got["median"] == got["low"] == got["high"] == 4 / 3
    assert inf.median_bootstrap(d, "x", 300, by=["s"])["median"] == 4 / 3
    none = inf.median_bootstrap(d.limit(0), "x", 10)
    assert none["n"] == 0 and none["median"] != none["median"]


def test_bootstrap_resamples_as_numpy_does(spark):
    """The same distribution of medians as by drawing rows, with ties, negative values, an even number of rows and strata."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=120), np.repeat([0.0, -0.5, 0.25], 20), rng.lognormal(5, 3, 20)])
    s = np.array(["ab"[i % 3 == 0] for i in range(len(x))])
    d = spark.createDataFrame([(float(v), k) for v, k in zip(x, s)] + [(None, "a"), (float("nan"), "b")], "x double, s string")
    strata = [np.flatnonzero(s == k) for k in "ab"]
    for by, groups in ((None, [np.arange(len(x))]), (["s"], strata)):
        got = inf.median_bootstrap(d, "x", 4000, 7, by)
        want = [np.median(np.concatenate([x[rng.choice(g, len(g))] for g in groups])) for _ in range(4000)]
        assert got["median"] == np.median(x) and got["n"] == len(x)
        assert (got["low"], got["high"]) == pytest.approx(np.percentile(want, [2.5, 97.5]), abs=0.05)
    assert inf.median_bootstrap(d, "x", 200, 7) == inf.median_bootstrap(d.repartition(5), "x", 200, 7)


def test_ordered_bits(spark):
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.inf])
    assert (np.diff(rk.ordered_bits(x).astype(object)) >= 0).all() and rk.ordered_bits(x)[4] == rk.ordered_bits(x)[5]


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", None, "c") for v in (rng.lognormal(size=500) if g != "c" else [3.0])] + [("d", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double")
    ps = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in rk.quantiles(d, "v", ps, ["g"]).collect()}
    assert set(got) == {"a", None, "c"}
    for g, r in got.items():
        x = [v for k, v in rows if k == g and v is not None and v == v]
        assert [r[k] for k in ps] == pytest.approx(np.quantile(x, list(ps.values()))) and r.n == len(x)
    assert rk.quantiles(d.limit(0), "v", ps).first().p50 is None and rk.quantiles(d.limit(0), "v", ps, ["g"]).count() == 0
    assert rk.exact_median(d.where("g = 'a'"), F.col("v")) == pytest.approx(np.median([v for k, v in rows if k == "a" and v == v])) and rk.exact_median(d.limit(0), F.col("v")) is None
    tied = spark.range(999).select(F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise(F.col("id").cast("double")).alias("v"))
    assert rk.exact_median(tied, F.col("v")) == np.median([2.0 if i % 3 == 0 else float(i) for i in range(999)])
    for values in ([1.0, 2.0], [-1.0, 0.0, -0.0, 1.0], [5e-324, 1e-323], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [float("-inf"), float("inf"), 3.0], [7.0] * 9):
        assert rk.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v")) == np.median(values)
    plan = rk.quantiles(d, "v", ps, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan

def test_contract_problems():
    assert va.contract_problems({"a": 1, "b": 2}, {"v": (1, 1)}, {"write": False}) == []
    assert len(va.contract_problems({"a": -1, "b": -1, "c": True}, {"v": (1, 2)}, {"write": True})) == 6


def test_liveness_and_eta(spark):
    from pairloom.streaming import streams as ss

    d = spark.createDataFrame([(1.0,), (100.0,), (1000.0,), (None,)], "age double")
    assert [r[0] for r in d.select(ss.liveness("age")).collect()] == ["LIVE", "STALE", "DEAD", "UNKNOWN"]
    assert ss.eta(50, 100, 10) == {"rows_per_second": 5.0, "seconds_left": 10.0} and ss.eta(0, 5, 1)["seconds_left"] is None


def test_decoded_tokens(spark):
    from pairloom.functions import tokenizer as tk

    d = tk.with_token_ids(spark.createDataFrame([("hello 가",), (None,)], "t string"), {"": "t"}).withColumn("d", tk.decoded_tokens("token_ids"))
    shown = d.first().d
    assert b"".join(bytes.fromhex(x.split(":")[1]) for x in shown).decode() == "hello 가"


def test_median_of_many_rows_is_that_of_the_data(spark):
    d = spark.range(12_000_000).select((F.col("id") % 2).cast("double").alias("x"))
    got = inf.median_bootstrap(d, "x", 301)
    assert got["median"] == 0.5 and got["n"] == 12_000_000
