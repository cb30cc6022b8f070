"""Sinks: validated promotion of Parquet folders, reports, manifests."""

from __future__ import annotations

import csv
import json
import os
import subprocess
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json_bytes, file_sha256, schema_fingerprint, set_fingerprint
from ..operators.validate import Violation


def write_validated(df: DataFrame, path: str, validate: Callable[[DataFrame], None], order: str | None = None, files: int | None = None) -> DataFrame:
    """Write beside ``path``, read back, validate, then rename: a failure promotes nothing, and what exists is never replaced.

    ``order``: rows in ranges of a column, sorted within files, so files hold disjoint ranges.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise Violation(f"{path} exists")
    partial = f"{path}.partial-{uuid.uuid4().hex[:8]}"
    out = df.repartitionByRange(*([files] if files else []), order).sortWithinPartitions(order) if order else df
    try:
        out.write.option("compression", "zstd").parquet(partial)
        back = spark.read.parquet(partial)
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise Violation("the written schema differs")
        validate(back)
    except BaseException:
        fs.delete(jvm.org.apache.hadoop.fs.Path(partial), True)
        raise
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(partial), target):
        raise Violation(f"{path} couldn't be promoted")
    return spark.read.parquet(path)


def _partial(path: str) -> Path:
    partial = Path(f"{path}.partial")
    if partial.exists():
        raise Violation(f"{partial} exists: another writer, or one that failed")
    return partial


def _atomic(path: str, data: bytes) -> None:
    partial = _partial(path)
    partial.write_bytes(data)
    os.replace(partial, path)


def write_counted(df: DataFrame, path: str, family: str) -> dict[object, int]:
    """Write a new folder of Parquet files and return the rows of each family, counted as they were written; families are few."""
    names = f"written-{uuid.uuid4().hex[:8]}"
    from pyspark.sql import Observation

    seen = Observation(names)
    levels = [r[0] for r in df.select(family).distinct().collect()]
    counts = [F.count_if(F.col(family).eqNullSafe(F.lit(v))).alias(f"f{i}") for i, v in enumerate(levels)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.option("compression", "zstd").parquet(path)
    got = seen.get
    out = {v: int(got[f"f{i}"]) for i, v in enumerate(levels)}
    if sum(out.values()) != got["rows"]:
        raise Violation("rows of unknown families were written")
    return out


def write_report(df: DataFrame, path: str, header: list[str]) -> int:
    """A CSV file with a fixed header, in the order of ``df``, at once or not at all; returns its rows. A partition is held at a time."""
    partial, rows = _partial(path), 0
    with partial.open("x", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        for r in df.select(*header).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
            rows += 1
    os.replace(partial, path)
    return rows


def write_canonical_json(value: object, path: str) -> None:
    _atomic(path, canonical_json_bytes(value))


def source_registry(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the rows and files observed for them, and whether the count is the expected one."""
    seen = registry.groupBy("source_id").agg(F.count("*").alias("observed_rows"), F.count_distinct("raw_file_relative_path").alias("observed_files"))
    joined = sources.join(seen, "source_id", "left").fillna(0, ["observed_rows", "observed_files"])
    return joined.select("source_id", "logical_corpus", "expected_row_count", "observed_rows", "observed_files", (F.col("expected_row_count") == F.col("observed_rows")).alias("as_expected"))


def manifest(df: DataFrame, key: str, **facts: object) -> dict:
    """What identifies an artifact: rows, columns, key set and schema."""
    got = set_fingerprint(df, key).first()
    return {"rows": got.n, "distinct_keys": got.n_distinct, "key_fold": str(got.fold), "columns": df.columns, "schema_sha256": schema_fingerprint(df), **facts}


def code_commit(folder: str | Path = ".") -> str | None:
    """The commit of the code at hand, with ``+`` if files were changed since; null outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return git("rev-parse", "HEAD") + ("+" if git("status", "--porcelain", "--untracked-files=no") else "")
    except (OSError, subprocess.CalledProcessError):
        return None


def write_manifest(df: DataFrame, key: str, folder: str, path: str, **facts: object) -> dict:
    """The manifest of a written table with its files' hashes and the code's commit, written and read back: what is read must equal what was meant."""
    data = [r for r in file_sha256(df.sparkSession, folder, recursiveFileLookup=True, pathGlobFilter="*.parquet").collect()]  # a row a file
    hashes = {r.path.rsplit("/", 1)[-1]: {"bytes": r.bytes, "sha256": r.sha256} for r in data}
    value = manifest(df, key, files=hashes, code_commit=code_commit(Path(__file__).parent), **facts)
    write_canonical_json(value, path)
    back = json.loads(Path(path).read_bytes())
    same_manifest(value, back)
    return back


def same_manifest(one: dict, two: dict) -> None:
    """Two manifests of one artifact agree, or there is an error naming what differs."""
    wrong = sorted(k for k in one.keys() | two.keys() if one.get(k) != two.get(k))
    if wrong:
        raise Violation(f"manifests differ in {wrong}")
