"""Percentiles and stable samples."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import percentiles as pc
from pairloom.llm import sample as sp

DAY = dt.datetime(2026, 3, 1, 12)


@given(st.lists(st.floats(allow_nan=False), min_size=2))
def test_integers_keep_the_order(x):
    k = pc.ordered_bits(np.array(x)).view(np.uint64)
    assert [x[i] + 0.0 for i in np.argsort(k, kind="stable")] == sorted(v + 0.0 for v in x)
    assert np.array_equal(pc.from_ordered_bits(k.view(np.int64)), np.array(x) + 0.0)


def measured(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, measured_at timestamp, v double")


def groups(spark, ids, g=lambda i: "g"):
    return spark.createDataFrame([(i, g(i)) for i in ids], "pair_id string, g string")


def values(d):
    return {(r.g, r.percentile): r.value for r in d.collect()}


def test_equal_to_numpy_with_ties_and_outliers(spark):
    random.seed(1)
    x = [random.choice([1.0, 2.0, 2.5, 1e9, -3.0, random.random()]) for _ in range(501)]
    rows = [(f"p{i}", DAY + dt.timedelta(days=i % 7), v) for i, v in enumerate(x)]
    rows += [("n1", DAY, None), ("n2", DAY, float("nan"))]
    pieces = pc.day_pieces(measured(spark, rows), groups(spark, [r[0] for r in rows]), ["g"], "pair_id", "v", "measured_at")
    got = values(pc.select_percentiles(pieces, ["g"]))
    for p in pc.PERCENTILES:
        assert got["g", p] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_remeasured_late_and_repeated_rows(spark):
    rows = [("a", DAY, 1.0), ("a", DAY, 1.0), ("a", DAY + dt.timedelta(days=9), 5.0), ("a", DAY + dt.timedelta(days=2), 3.0), ("b", DAY, 2.0), ("b", DAY + dt.timedelta(days=1), None), ("c", DAY, 7.0), (None, DAY, 9.0), ("d", None, 9.0), ("x", DAY, 100.0)]
    g = groups(spark, ["a", "b", "c", "d"], lambda i: None)
    pieces = pc.day_pieces(measured(spark, rows), g, ["g"], "pair_id", "v", "measured_at")
    r = pc.select_percentiles(pieces, ["g"], (0.5,)).first()
    assert (r.g, r.value, r.n) == (None, 6.0, 2)
    as_of = pc.select_percentiles(pieces.where(F.col("day") <= "2026-03-03"), ["g"], (0.5,)).first()
    assert (as_of.value, as_of.n) == (5.0, 2)


def test_pieces_of_days_combine(spark):
    rows = [(f"p{i}", DAY + dt.timedelta(days=i % 5), float(i * i % 97)) for i in range(200)]
    g = groups(spark, [f"p{i}" for i in range(200)])
    whole = pc.day_pieces(measured(spark, rows), g, ["g"], "pair_id", "v", "measured_at")
    parts = [pc.day_pieces(measured(spark, rows[k::3]), g, ["g"], "pair_id", "v", "measured_at") for k in range(3)]
    assert values(pc.select_percentiles(pc.combine(*parts), ["g"])) == values(pc.select_percentiles(whole, ["g"]))


def test_fewer_bits_keep_the_bound(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=400)
    rows = [(f"p{i}", DAY, float(v)) for i, v in enumerate(x)]
    pieces = pc.day_pieces(measured(spark, rows), groups(spark, [r[0] for r in rows]), ["g"], "pair_id", "v", "measured_at", bits=32)
    for r in pc.select_percentiles(pieces, ["g"], bits=32).collect():
        assert 0 < r.error_bound <= 2e-6 * r.value and abs(r.value - np.quantile(x, r.percentile)) <= r.error_bound


def test_the_bound_holds_for_the_smallest_doubles(spark):
    x = [5e-324 * k for k in (1, 3, 70_001, 2**40 + 5)] + [-5e-324 * 9, 2.3e-308]
    rows = [(f"p{i}", DAY, v) for i, v in enumerate(x)]
    pieces = pc.day_pieces(measured(spark, rows), groups(spark, [r[0] for r in rows]), ["g"], "pair_id", "v", "measured_at", bits=32)
    for r in pc.select_percentiles(pieces, ["g"], bits=32).collect():
        assert abs(r.value - np.quantile(x, r.percentile)) <= r.error_bound < 1e-308


def test_empty_and_infinite(spark):
    assert pc.select_percentiles(pc.day_pieces(measured(spark, []), groups(spark, ["a"]), ["g"], "pair_id", "v", "measured_at"), ["g"]).count() == 0
    rows = [("a", DAY, math.inf), ("b", DAY, -math.inf), ("c", DAY, 0.0), ("d", DAY, -0.0)]
    d = pc.select_percentiles(pc.day_pieces(measured(spark, rows), groups(spark, "abcd"), ["g"], "pair_id", "v", "measured_at"), ["g"], (0.5, 1.0))
    assert values(d) == {("g", 0.5): 0.0, ("g", 1.0): math.inf}


def test_sample_is_the_same_in_any_partitioning(spark):
    ids = spark.range(5000).select(F.format_string("id%d", "id").alias("k"), (F.col("id") % 3).alias("e"))
    epochs, rates = sp.first_epochs(ids, "k", "e"), spark.createDataFrame([(0, 0.05), (1, 0.05), (2, 0.5)], "epoch long, rate double")
    one = {r.k for r in sp.stable_sample(ids, epochs, rates, "k").collect()}
    two = {r.k for r in sp.stable_sample(ids.union(ids).repartition(9), epochs, rates, "k").collect()}
    assert one == two
    share = [sum(int(k[2:]) % 3 == e for k in one) / 1667 for e in range(3)]
    assert share == pytest.approx([0.05, 0.05, 0.5], abs=0.03)


def test_ledger_keeps_members_when_data_and_rates_grow(spark, tmp_path):
    ledger = sp.Ledger(spark, f"file://{tmp_path}/ledger")
    batch = lambda a, b: spark.range(a, b).select(F.format_string("id%d", "id").alias("k"))
    ledger.add(batch(0, 2000), "k", 0, 0.05)
    before = {r.k for r in sp.stable_sample(batch(0, 2000), ledger.epochs(), ledger.rates(), "k").collect()}
    ledger.add(batch(1000, 4000), "k", 1, 0.5)  # half of it seen before, under a higher rate
    after = {r.k for r in sp.stable_sample(batch(0, 4000), ledger.epochs(), ledger.rates(), "k").collect()}
    assert before <= after and before == {k for k in after if int(k[2:]) < 2000}
    with pytest.raises(ValueError):
        ledger.add(batch(0, 10), "k", 1, 0.9)


def test_ledger_observes_batches_in_any_number_of_steps(spark, tmp_path):
    d = spark.range(3000).select(F.format_string("id%d", "id").alias("k"), (F.col("id") % 4).alias("e"))
    d = d.unionByName(d.where("k like '%0'").withColumn("e", F.lit(9).cast("long"))).unionByName(spark.createDataFrame([(None, 1), ("z", None)], "k string, e long"))
    rate = lambda e: 0.05 * (1 + e % 2)
    one, two = sp.Ledger(spark, f"file://{tmp_path}/one"), sp.Ledger(spark, f"file://{tmp_path}/two")
    one.observe(d, "k", "e", rate)
    members = []
    for last in (0, 1, 2, 9):
        two.observe(d.where(F.col("e") <= last), "k", "e", rate if last < 9 else 0.9)
        members.append({r.k for r in sp.stable_sample(d, two.epochs(), two.rates(), "k").collect()})
    assert all(a <= b for a, b in zip(members, members[1:], strict=False))
    assert members[-1] >= {r.k for r in sp.stable_sample(d, one.epochs(), one.rates(), "k").where("first_epoch < 3").collect()}
    assert {r.epoch: r.rate for r in two.rates().collect() if r.epoch < 3} == {0: 0.05, 1: 0.1, 2: 0.05}
    assert two.epochs().count() == 3000 and two.epochs().where("first_epoch = 9").count() == 0
    assert sp.Ledger(spark, f"file://{tmp_path}/none").rates().count() == 0


def test_sample_of_nulls_and_nothing(spark):
    d = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "k string, e long")
    rates = spark.createDataFrame([(1, 1.0)], "epoch long, rate double")
    assert sp.stable_sample(d, sp.first_epochs(d, "k", "e"), rates, "k").count() == 0
    every = spark.createDataFrame([(2, 1.0)], "epoch long, rate double")
    assert [r.k for r in sp.stable_sample(d, sp.first_epochs(d, "k", "e"), every, "k").collect()] == ["b"]
    assert sp.stable_sample(d.limit(0), sp.first_epochs(d, "k", "e"), every, "k").count() == 0


def test_draws_are_independent_of_counter_and_seed(spark):
    d = spark.range(2000).select(F.format_string("i%d", "id").alias("k"))
    r = d.select(F.corr(sp.draw("k", 0), sp.draw("k", 1)).alias("a"), F.corr(sp.draw("k"), sp.draw("k", seed="other")).alias("b"), F.avg(sp.draw("k")).alias("m")).first()
    assert abs(r.a) < 0.08 and abs(r.b) < 0.08 and abs(r.m - 0.5) < 0.03
