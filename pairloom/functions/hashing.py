"""Identity and digests: length-prefixed SHA-256, provenance keys, set digests, seeds."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_prefixed(*columns: str | Column) -> Column:
    """For each string its byte length as 8 bytes, big end first, then its UTF-8 bytes; null as the empty string."""
    parts = []
    for c in columns:
        text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")), F.encode(text, "UTF-8")]
    return F.concat(*parts)


def length_prefixed_sha256(*columns: str | Column) -> Column:
    return F.sha2(length_prefixed(*columns), 256)


def duplicate_group_id(left: str, right: str, prefix: str = "dup_") -> Column:
    """Content identity of a raw pair: equal exactly when both raw texts are."""
    return F.concat(F.lit(prefix), length_prefixed_sha256(left, right))


def pair_id(source: str, record: str, prefix: str = "pair_") -> Column:
    """Provenance identity of a record within its source."""
    return F.concat(F.lit(prefix), length_prefixed_sha256(source, record))


def source_id(label: str | Column, manifest_sha256: str | Column) -> Column:
    """Identity of one snapshot of a source: a new manifest makes another source. Null if either is."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(c(label), F.lit("@raw-manifest:"), c(manifest_sha256))


def salted_pair_digest(left: str | Column, right: str | Column, salt: bytes) -> Column:
    """32 bytes that are equal exactly when both texts are, and say nothing of them without the salt, which is made for a run and not kept."""
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(salt)), length_prefixed(left, right)), 256))


def measurement_id(prefix: str, schema_version: str, config_sha256: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", F.lit(schema_version), F.lit(config_sha256), F.col(key)), 256))


def canonical_json(value: object) -> str:
    """Sorted keys, compact, nothing escaped that needn't be, no newline."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_json_bytes(value: object) -> bytes:
    return (canonical_json(value) + "\n").encode()


def canonical_metadata(column: str | Column, without: tuple[str, ...] = ()) -> Column:
    """A JSON object of strings with its keys sorted and those of ``without`` dropped; null where it is no object."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*without)) if without else entries
    return F.to_json(F.map_from_entries(F.array_sort(kept, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))), {"ignoreNullFields": "false"})


def _ordered_digest(df: DataFrame, key: str, algorithm: str, end: str) -> DataFrame:
    """``digest`` over all keys in order. A hash of a sequence is one sequence of steps, so there is one task; it sorts on disk and holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.new(algorithm)
        for b in batches:
            h.update("".join(f"{k}{end}" for k in b.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["digest"])

    keys = df.select(F.col(key).cast("string").alias("k")).where("k is not null")
    found = keys.repartition(1).sortWithinPartitions("k").mapInArrow(run, "digest string")
    return found.agg(F.coalesce(F.max("digest"), F.lit(hashlib.new(algorithm).hexdigest())).alias("digest"))  # an empty table may start no task


def sorted_set_digest(df: DataFrame, key: str) -> DataFrame:
    """``digest``: MD5 of all keys in order, joined. For large sets ``set_fingerprint`` needs no order."""
    return _ordered_digest(df, key, "md5", "")


def sorted_lines_digest(df: DataFrame, key: str) -> DataFrame:
    """``digest``: SHA-256 over the keys in order, each ended by a newline."""
    return _ordered_digest(df, key, "sha256", "\n")


def set_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """``n, n_distinct, fold``: the same for equal sets in any order and partitioning, combined on the map side; no ordering is needed."""
    low = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("n_distinct"), F.sum(low).alias("fold"))


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the ordered names, nullabilities and types."""
    fields = [{"name": f.name, "nullable": f.nullable, "type": f.dataType.simpleString()} for f in df.schema]
    return hashlib.sha256(canonical_json_bytes(fields)).hexdigest()


def seed(label: str | Column) -> Column:
    """An unsigned 32-bit number: the first 8 hex digits of the label's SHA-256."""
    return F.conv(F.substring(F.sha2(F.lit(label) if isinstance(label, str) else label, 256), 1, 8), 16, 10).cast("long")


PIECE = 1 << 20


def open_file(path: str):  # noqa: ANN201
    """A seekable binary file on any file system that executors see."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return open(local, "rb")
    from pyarrow.fs import FileSystem

    fs, inside = FileSystem.from_uri(path)
    return fs.open_input_file(inside)


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    """A file's bytes, ``size`` at a time."""
    with open_file(path) as f:
        while piece := f.read(size):
            yield piece


def files(spark, paths: str | list[str], **options: object) -> DataFrame:  # noqa: ANN001
    """``path, length`` of files; their content is not read. Tasks are cut by the files' lengths."""
    return spark.read.format("binaryFile").options(**options).load(paths).select("path", "length")


def file_sha256(spark, paths: str | list[str], **options: object) -> DataFrame:  # noqa: ANN001
    """``path, bytes, sha256`` of files, hashed piece by piece where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for path in b.column(0).to_pylist():
                h = hashlib.sha256()
                for piece in pieces(path):
                    h.update(piece)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])

    return files(spark, paths, **options).mapInArrow(run, "path string, bytes long, sha256 string")
