from __future__ import annotations

import hashlib
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.validate import Violation
from pairloom.sources import readers as rd
from pairloom.sources import sinks as sk
from pairloom.streaming import streams as ss


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"data": [{"sn": "1", "ko": "가"}, {"sn": "2", "ko": None}]}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "in/b.json").write_text('{"meta": 1, "data": []}')
    return tmp_path


def test_json_records(spark, files):
    record = T.StructType([T.StructField("sn", T.StringType()), T.StructField("ko", T.StringType())])
    got = rd.json_records(spark, [str(files / "in/a.json"), str(files / "in/b.json")], record)
    assert sorted((r["index"], r.sn, r.ko) for r in got.collect()) == [(0, "1", "가"), (1, "2", None)]
    loose = rd.json_lines_of_array(spark, str(files / "in/a.json")).collect()
    assert [json.loads(r.record)["sn"] for r in loose] == ["1", "2"]


def workbook(path, sheets=1):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>원문</t></si><si><t>안녕</t></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7.0</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>9</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>in</t></is></c></row>'
        for i in range(sheets):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_worksheet(spark, tmp_path):
    workbook(tmp_path / "x.xlsx")
    got = sorted((r.row_number, r.record) for r in rd.worksheet_rows(spark, str(tmp_path / "x.xlsx")).collect())
    assert got == [(2, {"id": "7", "원문": "안녕"}), (4, {"id": None, "원문": "in"})]
    workbook(tmp_path / "two.xlsx", 2)
    with pytest.raises(Exception, match="one worksheet"):
        rd.worksheet_rows(spark, str(tmp_path / "two.xlsx")).collect()


def test_inventory_against_list(spark, files):
    found = rd.inventory(spark, str(files / "in"))
    assert {r.path for r in found.collect()} == {"a.json", "b.json"}
    sha = {r.path: r.sha256 for r in found.collect()}
    allowed = spark.createDataFrame([("a.json", sha["a.json"]), ("b.json", "0" * 64), ("c.json", "1" * 64)], "path string, sha256 string")
    assert {tuple(r) for r in rd.verified(found, allowed).collect()} == {("b.json", "changed"), ("c.json", "missing")}


def test_contracts(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    c = rd.contract(str(tmp_path / "c.json"))
    assert rd.lookup(c, "a.b") == 1
    with pytest.raises(Violation):
        rd.lookup(c, "a.x")
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(Violation):
        rd.contract(str(tmp_path / "d.json"))


def test_staging_and_batches(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.BooleanType())])
    d = spark.createDataFrame([("1", "x")], "a string, extra string")
    assert tuple(rd.staging(d, schema, b=F.lit("y")).first()) == (1, "y", None)
    with pytest.raises(Violation):
        rd.staging(d, schema, z=F.lit(1))
    for bad in (0, -1, True, "5"):
        with pytest.raises(ValueError):
            rd.in_batches(d, bad, lambda b: b, d.schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = rd.in_batches(spark.range(25).coalesce(1), 10, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long")
    assert [r.n for r in sizes.collect()] == [10, 10, 5] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_arrays_in_pieces_of_any_size(size):
    value = {"meta": {"data": 5, "x": "\"data\": ["}, "data": [{"가": "나", "b": [1, {"c": "]"}]}, 12, 345, "말]", None, {"d": -1.5e3}], "after": [1]}
    for text in (json.dumps(value, ensure_ascii=False), json.dumps(value, indent=2)):
        data = b"\xef\xbb\xbf" + text.encode()
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        if "x" not in value["meta"] or size:
            value_found = list(rd.array_items(parts, "data"))
            assert value_found == value["data"]
    assert list(rd.array_items([b'{"other": [1]}'], "data")) == []
    with pytest.raises(Violation):
        list(rd.array_items([b'{"data": [1, 2'], "data"))


def test_row_counts_of_files(spark, files):
    lines = rd.json_lines_of_array(spark, str(files / "in")).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    expected = spark.createDataFrame([("a.json", 2), ("b.json", 1)], "file string, expected long")
    assert [tuple(r) for r in rd.row_count_problems(lines, expected).collect()] == [("b.json", 1, 0)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b/two.txt", "two")
        z.writestr("one.txt", "1" * 3_000_000)
        z.mkdir("b/empty")
    got = {r.member: (r.bytes, r.sha256) for r in rd.zip_members(spark, str(tmp_path / "z.zip")).collect()}
    assert got == {"b/two.txt": (3, hashlib.sha256(b"two").hexdigest()), "one.txt": (3_000_000, hashlib.sha256(b"1" * 3_000_000).hexdigest())}


def test_validated_write(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    path = str(tmp_path / "out")

    def fail(_):
        raise Violation("no")

    with pytest.raises(Violation):
        sk.write_validated(d, path, fail)
    assert list(tmp_path.iterdir()) == []
    back = sk.write_validated(d, path, lambda x: None, order="k", files=2)
    assert back.count() == 2
    with pytest.raises(Violation):
        sk.write_validated(d, path, lambda x: None)


def test_reports_and_manifests(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, 'q"x')], "k int, v string")
    assert sk.write_report(d, str(tmp_path / "r.csv"), ["k", "v"]) == 2
    assert (tmp_path / "r.csv").read_text().splitlines()[0] == "k,v"
    assert sk.write_report(spark.range(150_000).toDF("k"), str(tmp_path / "s.csv"), ["k"]) == 150_000
    (tmp_path / "t.csv.partial").write_text("")
    with pytest.raises(Violation):
        sk.write_report(d, str(tmp_path / "t.csv"), ["k"])
    assert sk.write_counted(d, str(tmp_path / "counted"), "v") == {None: 1, 'q"x': 1}
    full = sk.write_manifest(spark.read.parquet(str(tmp_path / "counted")), "k", str(tmp_path / "counted"), str(tmp_path / "full.json"), stage="y")
    assert full["rows"] == 2 and full["files"] and all(len(f["sha256"]) == 64 for f in full["files"].values()) and full["stage"] == "y"
    assert sk.code_commit(tmp_path) is None
    m = sk.manifest(d, "k", stage="x")
    sk.write_canonical_json(m, str(tmp_path / "m.json"))
    sk.same_manifest(m, json.loads((tmp_path / "m.json").read_text()))
    with pytest.raises(Violation):
        sk.same_manifest(m, m | {"rows": 3})


def test_streams_equal_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "src")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    stream = ss.file_stream(spark, src, events.schema)
    q = ss.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type, r.n) for r in ss.windowed_counts(events, "ts", "event_type").collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.table("counted").collect()} == want


def test_flag_stream_to_files(spark, tmp_path):
    d = spark.createDataFrame([("가나다", "abc"), ("", "x"), (None, "y")], "ko_text_analysis string, en_text_analysis string")
    src = str(tmp_path / "in")
    d.write.parquet(src)
    q = ss.to_parquet(ss.structural_flags(ss.file_stream(spark, src, d.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.empty_text_flag for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True, True]
