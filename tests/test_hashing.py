from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from pairloom.functions import hashing as hs


def prefixed(*texts: str) -> str:
    return hashlib.sha256(b"".join(struct.pack(">Q", len(t.encode())) + t.encode() for t in texts)).hexdigest()


def test_length_prefixed_hash_equals_independent_construction(spark):
    d = spark.createDataFrame([("한글🙂", "English"), ("", ""), ("a", None)], "ko string, en string")
    got = [r[0] for r in d.select(hs.length_prefixed_sha256("ko", "en")).collect()]
    assert got == [prefixed("한글🙂", "English"), prefixed("", ""), prefixed("a", "")]


def test_pair_id_is_provenance_not_content(spark):
    d = spark.createDataFrame([("s", "SN-1"), ("s", "SN-2")], "source string, record string")
    a, b = (r[0] for r in d.select(hs.pair_id("source", "record")).collect())
    assert a != b and a.startswith("pair_") and len(a) == 69


def test_prefixes_keep_boundaries_apart(spark):
    d = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    a, b = (r[0] for r in d.select(hs.length_prefixed_sha256("x", "y")).collect())
    assert a != b


def test_set_digests_do_not_depend_on_order_or_partitions(spark):
    ids = [f"id{i}" for i in range(50)]
    one = spark.createDataFrame([(i,) for i in ids], "k string").repartition(1)
    two = spark.createDataFrame([(i,) for i in reversed(ids)], "k string").repartition(7)
    assert hs.sorted_set_digest(one, "k").first() == hs.sorted_set_digest(two, "k").first()
    assert hs.set_fingerprint(one, "k").first() == hs.set_fingerprint(two, "k").first()
    want = hashlib.md5("".join(sorted(ids)).encode()).hexdigest()
    assert hs.sorted_set_digest(one, "k").first().digest == want
    lines = hashlib.sha256("".join(f"{i}\n" for i in sorted(ids)).encode()).hexdigest()
    assert hs.sorted_lines_digest(two, "k").first().digest == lines


def test_digests_of_empty_tables(spark):
    d = spark.createDataFrame([], "k string")
    assert hs.sorted_set_digest(d, "k").first().digest == hashlib.md5(b"").hexdigest()
    assert hs.set_fingerprint(d, "k").first().n == 0


@pytest.mark.parametrize("label", ["NB08|primary", "한국어"])
def test_seed(spark, label):
    assert spark.range(1).select(hs.seed(label)).first()[0] == int(hashlib.sha256(label.encode()).hexdigest()[:8], 16)


def test_canonical_json():
    assert hs.canonical_json({"b": 1, "a": "한"}) == '{"a":"한","b":1}'
    assert hs.canonical_json_bytes({}) == b"{}\n"


def test_canonical_metadata_sorts_and_drops(spark):
    d = spark.createDataFrame([('{"b":"2","a":"1","text":"x"}',), ("no json",), (None,)], "m string")
    assert [r[0] for r in d.select(hs.canonical_metadata("m", ("text",))).collect()] == ['{"a":"1","b":"2"}', None, None]


def test_schema_fingerprint_sees_order_and_type(spark):
    a = spark.range(1).select(F.lit(1).alias("x"), F.lit("s").alias("y"))
    assert hs.schema_fingerprint(a) != hs.schema_fingerprint(a.select("y", "x"))
    assert hs.schema_fingerprint(a) != hs.schema_fingerprint(a.withColumn("x", F.col("x").cast("long")))
