"""Gates, orders, samples, protocols and block tests on fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import quality as ql
from pairloom.operators import aggregate as ag
from pairloom.operators import models as ml
from pairloom.operators import protocols as pr
from pairloom.operators import sampling as sm
from pairloom.operators import validate as va
from pairloom.plans import contract_queries as cq


def test_differing_fields_with_nulls_nan_and_missing_keys(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", float("nan")), (3, "z", 1.0), (5, "w", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", float("nan")), (3, "z", 1.5), (4, "w", 2.0)], "k int, s string, v double")
    assert {r.field: r.differing for r in va.differing_fields(a, b, "k").collect()} == {"(rows)": 2, "s": 1, "v": 1}
    assert {r.differing for r in va.differing_fields(a, a, "k").collect()} == {0}


@pytest.mark.parametrize("parts", [1, 7])
def test_order_breaks_across_ranges(spark, parts):
    values = [3, 1, None, 2, 2, 5, 4, 6, 0, 9]
    d = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = va.order_breaks(d, ["i"], "v").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (r.rows, r.breaks) == (10, sum(a is not None and b is not None and b < a for a, b in zip(values, values[1:])))
    assert tuple(va.order_breaks(d.limit(0), ["i"], "v").first()) == (0, 0)


def test_reservoirs_merge_and_do_not_depend_on_order(spark):
    d = spark.range(500).select(F.format_string("k%d", "id").alias("k"), (F.col("id") % 2).alias("g"))
    one = {r.k for r in sm.reservoir(d, "k", 40, 1).collect()}
    two = {r.k for r in sm.reservoir(d.orderBy(F.desc("k")).repartition(6), "k", 40, 1).collect()}
    halves = sm.reservoir(d.where("g = 0"), "k", 40, 1).unionByName(sm.reservoir(d.where("g = 1"), "k", 40, 1))
    assert one == two == {r.k for r in sm.reservoir(halves, "k", 40, 1).collect()} and len(one) == 40
    assert one != {r.k for r in sm.reservoir(d, "k", 40, 2).collect()}
    assert {r.g: r["count"] for r in sm.reservoir(d, "k", 10, 1, ["g"]).groupBy("g").count().collect()} == {0: 10, 1: 10}


def test_direction_of_records(spark):
    full = {"source_language": "ko", "target_language": "en"}
    rows = [
        ("strong", full | {"ko_original": "말"}, "KO_TO_EN"), ("weak", full, "KO_TO_EN"), ("both", full | {"ko_original": "말", "en_original": "word"}, "KO_TO_EN"), ("against", full | {"en_original": "word"}, "KO_TO_EN"),
        ("other file", full | {"ko_original": "말"}, "EN_TO_KO"), ("none", {}, "KO_TO_EN"), ("empty", full | {"en_original": ""}, "KO_TO_EN"), ("null", None, "EN_TO_KO"), ("strong en", {"source_language": "en", "target_language": "ko", "en_original": "w"}, "EN_TO_KO"),
    ]
    d = spark.createDataFrame(rows, "k string, m map<string,string>, e string")
    got = {r[0]: tuple(r[1:]) for r in d.select("k", *ql.direction(F.col("m"), F.col("e")).values()).collect()}
    unknown = ("UNKNOWN", True)
    assert got == {
        "strong": ("KO_TO_EN", False), "weak": ("KO_TO_EN", True), "both": ("KO_TO_EN", True), "against": unknown, "other file": unknown, "none": unknown, "empty": ("KO_TO_EN", True), "null": unknown, "strong en": ("EN_TO_KO", False),
    }


def test_protocols_can_be_exchanged(spark):
    class Long:
        def flags(self, df):
            return {"long": F.length("t") > 3, "odd": F.col("t").startswith("?")}

    class Any_:
        def status(self, flags):
            return F.when(F.greatest(*(F.col(f) for f in flags)), "bad").otherwise("good")

    d = spark.createDataFrame([("abcd", 1), ("?", 2), ("ab", 3), (None, 4)], "t string, long int")
    flagged, summary = pr.run(d, Long(), Any_(), pr.FlagCounts())
    assert {r.t: r.status for r in flagged.collect()} == {"abcd": "bad", "?": "bad", "ab": "good", None: "good"}
    assert {r.status: (r.n, r.long, r.odd) for r in summary.collect()} == {"bad": (2, 1, 1), "good": (2, 0, 0)} and "t" not in summary.columns


def test_catalogue_has_each_rule_once_and_finds_faults(spark, sf_dir):
    assert len(cq.CATALOGUE) > 60 and {k for k, _ in cq.CATALOGUE.values()} == {"HARD", "DEFINITIONAL"}
    good = spark.read.parquet(f"{sf_dir}/rep_features.parquet").limit(1)
    for change, rule in (({"ko_hangul_share": F.lit(1.5)}, "ko_hangul_share_at_most_one"), ({"en_utf8_bytes": F.lit(0)}, "en_utf8_bytes_positive"), ({"unicode_version": F.lit(None)}, "provenance_is_there"), ({"pair_byte_ratio": F.lit(float("inf"))}, "pair_byte_ratio_finite_and_positive")):
        row = good.withColumns(change).select(F.expr(cq.CATALOGUE[rule][1]).alias("x")).first()
        assert row.x
        assert not good.select(F.coalesce(F.expr(cq.CATALOGUE[rule][1]), F.lit(False)).alias("x")).first().x


def test_rank_correlations_equal_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    p = pd.DataFrame({"a": rng.integers(0, 9, 200), "b": rng.normal(size=200), "c": 1})
    p["d"] = p.a + rng.integers(0, 3, 200)
    got = {(r.family, r.a, r.b): r.rho for r in ag.rank_correlations(spark.createDataFrame(p), {"x": ["a", "b", "d"], "y": ["a", "c"]}).collect()}
    want = p.rank().corr()
    assert got["y", "a", "c"] is None
    for a, b in (("a", "b"), ("a", "d"), ("b", "d")):
        assert got["x", a, b] == pytest.approx(want.loc[a, b])


def test_wald_and_gains_equal_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 3))
    y = 1 + x @ [0.5, 0.2, 0.0] + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
    d = spark.createDataFrame([(f"k{i}", *map(float, x[i]), float(y[i])) for i in range(n)], "k string, x0 double, x1 double, x2 double, y double")
    g = ml.gram(d, ["x0", "x1", "x2"], ["y"])
    fit = ml.ols(g, "y")
    a = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ beta
    inv = np.linalg.inv(a.T @ a)
    cov = inv @ (a.T * e**2) @ a @ inv * n / (n - 4)
    want = beta[[2, 3]] @ np.linalg.inv(cov[np.ix_([2, 3], [2, 3])]) @ beta[[2, 3]]
    assert ml.wald(d, fit, ["x1", "x2"]) == {"wald_chi2": pytest.approx(want), "df": 2}
    draws = ml.bootstrap_gain(d, g, fit, {"b": ["x1", "x2"]}, "k", 300, 5)["b"]
    gain = ml.nested(fit, ml.ols(g, "y", ["x0"]))["delta_r2"]
    assert len(draws) == 300 and (draws >= -1e-12).all() and np.percentile(draws, 2.5) < gain < np.percentile(draws, 97.5)
    assert [t["what"] for t in ml.triggers(g, {"pair": ["x0", "x1"]})] == ["condition", "max_vif", "gvif:pair"] and not any(t["triggered"] for t in ml.triggers(g, {"pair": ["x0", "x1"]}))


def test_envelope_levels():
    from pairloom.operators.telemetry import Envelope

    e = Envelope()
    assert e.level(9, 0, 1) == ("GREEN", [])
    assert [e.level(a, s, o)[0] for a, s, o in ((7, 0, 1), (9, 0.2, 1), (4.5, 0, 1), (9, 0.6, 1), (9, 0, 7), (3, 0, 1), (9, 1.5, 1))] == ["YELLOW", "YELLOW", "RED", "RED", "RED", "EMERGENCY", "EMERGENCY"]


def test_telemetry_samples_and_aborts(spark, tmp_path):
    import json
    import time

    from pairloom.operators.telemetry import Telemetry, read_memory

    done = iter(range(0, 10_000, 10))
    with Telemetry(interval=0.02, rows=lambda: next(done), read=lambda: (20.0, 0.0, 1.0), most=8, log=str(tmp_path / "log")) as t:
        time.sleep(0.5)
    got = t.summary()
    assert got["periodic"] and got["samples"] > 4 and len(t.samples) <= 9 and got["worst_level"] == "GREEN" and got["rows_per_second"] > 0
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert len(lines) == got["samples"] and json.loads((tmp_path / "log.latest").read_text()) == lines[-1]
    reads = iter([(9.0, 1.0, 1.0), (9.0, 1.0, 1.0), (4.2, 1.0, 1.0), *[(9.0, 1.0, 1.0)] * 500])
    with pytest.raises(va.Violation, match="RED"), Telemetry(spark, interval=0.02, read=lambda: next(reads)) as t:
        time.sleep(0.2)
    assert t.summary()["worst_level"] == "RED" and t.summary()["least_available_gib"] == 4.2
    assert read_memory()[0] > 0
    assert Telemetry().summary()["samples"] == 0


def test_json_profile_tells_absent_null_and_empty_apart(spark):
    rows = ['{"a": "x", "b": 1}', '{"a": "", "b": 2.5}', '{"a": null, "c": [1]}', '{"b": true, "c": {"d": 1}}', "not json", "[1]", None, "{}"]
    got = {r.field: r for r in ag.json_profile(spark.createDataFrame([(r,) for r in rows], "j string"), "j").collect() if r.field is not None}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.absent, a.nulls, a.empty, a.strings, a.distinct_values) == (2, 1, 1, 2, 2)
    assert (b.absent, b.numbers, b.booleans, b.distinct_values) == (2, 2, 1, 3) and (c.absent, c.arrays, c.objects, c.distinct_values) == (3, 1, 1, 0)
