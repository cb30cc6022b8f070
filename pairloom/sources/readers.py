"""Sources: JSON arrays of records, worksheets, file inventories, contracts."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from io import BytesIO
from itertools import islice
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as hs
from ..operators.validate import Violation


def in_batches(df: DataFrame, size: int, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``run`` over batches of at most ``size`` rows, in this scan alone; a size that is no positive whole number is refused."""
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError("a batch size is a positive whole number")

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, size):
                yield run(b.slice(at, size))

    return df.mapInArrow(each, schema)


ROWS = 5_000  # records given on at once


def array_items(parts: Iterable[bytes], array: str = "data") -> Iterator[object]:
    """The items of the array of this name in a JSON document that comes in pieces; no more than an item and a piece are held.

    Nothing without the array; an error if it doesn't end.
    """
    decode, decoder = codecs.getincrementaldecoder("utf-8-sig")().decode, json.JSONDecoder()
    start = re.compile(rf'"{re.escape(array)}"\s*:\s*\[')
    text, at, inside = "", 0, False
    for part in parts:
        text, at = text[at:] + decode(part), 0
        if not inside:
            found = start.search(text)
            if not found:
                text = text[-len(array) - 64 :]  # the name may be cut by the end of a piece
                continue
            inside, at = True, found.end()
        while True:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            if at < len(text) and text[at] == "]":
                return
            try:
                value, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                break
            if end == len(text):  # a number may go on in the next piece
                break
            yield value
            at = end
    if inside:
        raise Violation(f"the array {array} doesn't end")


def json_lines_of_array(spark: SparkSession, paths: str | list[str], array: str = "data") -> DataFrame:
    """``file, index, record``: each object of the array as JSON text with sorted keys, for files of any size: they are read in pieces."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                items = enumerate(array_items(hs.pieces(path), array))
                while some := list(islice(items, ROWS)):
                    rows = [(path, i, json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for i, v in some]
                    yield pd.DataFrame(rows, columns=["file", "index", "record"])

    return hs.files(spark, paths).mapInPandas(run, "file string, index long, record string")


def json_records(spark: SparkSession, paths: str | list[str], record: T.StructType, array: str = "data") -> DataFrame:
    """One row for each object in the ``array`` of each file, with its ``file`` and ``index`` (from 0). A file without the array gives none."""
    return json_lines_of_array(spark, paths, array).select("file", "index", F.from_json("record", record).alias("_r")).select("file", "index", "_r.*")


def row_count_problems(records: DataFrame, expected: DataFrame, by: str = "file") -> DataFrame:
    """``<by>, expected, found`` where the rows of a file, or of a family of files, aren't as many as listed (``<by>, expected``). Empty if all are."""
    found = records.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("found"))
    both = expected.select(by, "expected").join(found, F.col(by).eqNullSafe(F.col("_b")), "full")
    return both.select(F.coalesce(by, "_b").alias(by), "expected", F.coalesce("found", F.lit(0)).alias("found")).where(~F.col("expected").eqNullSafe(F.col("found")))


def _cells(content: bytes) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Row number and cells of the first worksheet of a workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        if len(sheets) != 1:
            raise Violation(f"a workbook has one worksheet, not {len(sheets)}")
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else k
                value = c.find("m:v", ns)
                if c.get("t") == "inlineStr":
                    cells[column] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif value is not None and value.text is not None:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                    cells[column] = text if c.get("t") in ("s", "str") else re.sub(r"\.0+$", "", text)
            yield int(row.get("r", "0")), cells


def worksheet_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, row_number, record``: rows below the header as a map from header to text. Columns without a header are dropped; row numbers are the sheet's, from 2."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows, header = [], None
                for number, cells in _cells(content):
                    if header is None:
                        header = {k: v for k, v in cells.items() if v}
                    elif cells:
                        rows.append((path, number, {h: cells.get(k) for k, h in header.items()}))
                yield pd.DataFrame(rows, columns=["file", "row_number", "record"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, row_number int, record map<string,string>")


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256`` of the files below a folder, relative to it."""
    files = hs.file_sha256(spark, folder, recursiveFileLookup=True, pathGlobFilter=pattern)
    root = folder.rstrip("/").removeprefix("file:")
    return files.withColumn("path", F.regexp_replace("path", rf"^(file:)?/*{re.escape(root.lstrip('/'))}/", ""))


def zip_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, member, bytes, sha256`` of what zip files hold, folders aside; members are hashed piece by piece."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                rows = []
                with hs.open_file(path) as f, zipfile.ZipFile(f) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if not info.is_dir():
                            h = hashlib.sha256()
                            with z.open(info) as m:
                                while piece := m.read(hs.PIECE):
                                    h.update(piece)
                            rows.append((path, info.filename, info.file_size, h.hexdigest()))
                yield pd.DataFrame(rows, columns=["file", "member", "bytes", "sha256"])

    return hs.files(spark, paths).mapInPandas(run, "file string, member string, bytes long, sha256 string")


def verified(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """``path, problem`` of an inventory against a list of ``path, sha256``: missing, unexpected or changed files. Empty if all is as listed."""
    a, b = allowed.select("path", F.col("sha256").alias("_w")), found.select("path", F.col("sha256").alias("_h"))
    problem = F.when(F.col("_w").isNull(), "unexpected").when(F.col("_h").isNull(), "missing").when(F.col("_w") != F.col("_h"), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def contract(path: str) -> dict:
    """A JSON or simple YAML mapping; anything else at the root is refused."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml

            value = yaml.safe_load(text)
        except ImportError as e:
            raise Violation("YAML needs the yaml module; JSON doesn't") from e
    if not isinstance(value, dict):
        raise Violation("a contract is a mapping")
    return value


def lookup(mapping: dict, dotted: str) -> object:
    """The value at a dotted path; an error if there is none."""
    at: object = mapping
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            raise Violation(f"the contract has no {dotted}")
        at = at[part]
    return at


def staging(df: DataFrame, schema: T.StructType, **values: Column) -> DataFrame:
    """Rows in the order of a schema: given columns, those of ``df``, typed nulls for the rest. A given name outside the schema is refused."""
    unknown = set(values) - set(schema.names)
    if unknown:
        raise Violation(f"not in the schema: {sorted(unknown)}")
    pick = lambda f: values[f.name] if f.name in values else F.col(f.name) if f.name in df.columns else F.lit(None)
    return df.select(*(pick(f).cast(f.dataType).alias(f.name) for f in schema))
