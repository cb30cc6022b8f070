"""Byte-pair tokens and regular-expression chunks of texts, with their exact identities."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARIES = os.environ.get("PAIRLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_KINDS = ("letter", "number", "punctuation", "whitespace")


@lru_cache(4)
def encoding(path: str):  # noqa: ANN201
    """The encoding of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(path: str | None = None, sha256: str | None = None) -> str:
    """The file's path; an error if it isn't the one with this hash."""
    path = path or f"{VOCABULARIES}/{DEFAULT}"
    if sha256 is not None:
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != sha256:
                raise ValueError(f"{path} is not the vocabulary asked for")
    return path


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary along with the job, so that executors need not have it; returns the name that ``shipped`` takes."""
    sent = ship.__dict__.setdefault("sent", set())
    if (spark.sparkContext.applicationId, path) not in sent:
        spark.sparkContext.addFile(path)
        sent.add((spark.sparkContext.applicationId, path))
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Where a worker finds a file that was sent along."""
    return SparkFiles.get(name)


def rank_hash(path: str) -> str:
    """SHA-256 over rank, length and bytes of each token in rank order."""
    h = hashlib.sha256()
    for token, rank in sorted(encoding(path)._mergeable_ranks.items(), key=lambda x: x[1]):
        h.update(rank.to_bytes(8, "big") + len(token).to_bytes(4, "big") + token)
    return h.hexdigest()


def _over_batches(df: DataFrame, columns: list[str], fields: list[T.StructField], row, path: str) -> DataFrame:  # noqa: ANN001
    """All other columns of ``df`` plus ``fields``, which ``row(encoding, *values)`` gives for each row."""
    schema = T.StructType([*df.schema.fields, *fields])
    at = [df.columns.index(c) for c in columns]
    name = ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            e = encoding(shipped(name))
            rows = [row(e, *v) for v in zip(*(b.column(k).to_pylist() for k in at), strict=True)]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def with_token_ids(df: DataFrame, texts: dict[str, str], path: str | None = None) -> DataFrame:
    """``df`` plus, for each prefix and text column, ``<prefix>token_ids`` and ``<prefix>roundtrip_ok``. Null text has no tokens."""
    fields = [f for p in texts for f in (T.StructField(f"{p}token_ids", T.ArrayType(T.IntegerType())), T.StructField(f"{p}roundtrip_ok", T.BooleanType()))]

    def row(e, *values):  # noqa: ANN001, ANN002, ANN202
        out = []
        for v in values:
            ids = e.encode_ordinary(v or "")
            out += [ids, e.decode(ids) == (v or "")]
        return out

    return _over_batches(df.drop(*(f.name for f in fields)), list(texts.values()), fields, row, vocabulary_path(path))


def decomposition() -> dict[str, Column]:
    """Token premium and its exact factors, from ``{ko,en}_{tokens,codepoints,bytes}``. A zero denominator gives null."""
    n = lambda s, what: F.nullif(F.col(f"{s}_{what}").cast("double"), F.lit(0.0))
    tp = n("ko", "tokens") / n("en", "tokens")
    cr = n("ko", "codepoints") / n("en", "codepoints")
    bdr = (n("ko", "bytes") / n("ko", "codepoints")) / (n("en", "bytes") / n("en", "codepoints"))
    cp = (n("ko", "tokens") / n("ko", "bytes")) / (n("en", "tokens") / n("en", "bytes"))
    return {
        "token_difference": F.col("ko_tokens") - F.col("en_tokens"), "token_premium": tp, "log_token_premium": F.ln(tp),
        "code_point_ratio": cr, "byte_density_ratio": bdr, "compression_penalty": cp,
        "log_code_point_ratio": F.ln(cr), "log_byte_density_ratio": F.ln(bdr), "log_compression_penalty": F.ln(cp),
        "identity_abs_error": F.abs(F.ln(tp) - (F.ln(cr) + F.ln(bdr) + F.ln(cp))),
    }


def chunks(text: str | Column, pattern: str) -> Column:
    """The chunks of a text by a pattern that Java knows, in order."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def chunk_kind(chunk: Column) -> Column:
    return F.when(chunk.rlike(r"\p{L}"), "letter").when(chunk.rlike(r"\p{N}"), "number").when(chunk.rlike(r"^\p{IsWhite_Space}+$"), "whitespace").otherwise("punctuation")


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank percentile of an array: an element of it."""
    n = F.size(values)
    return F.try_element_at(F.sort_array(values), F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(q)).cast("int"))))


def array_median(values: Column) -> Column:
    """The mean of the middle two; null for none."""
    s, n = F.sort_array(values), F.size(values)
    pick = lambda i: F.try_element_at(s, F.greatest(i, F.lit(1)))
    return (pick(F.floor((n + 1) / 2).cast("int")) + pick(F.floor(n / 2).cast("int") + 1)) / F.lit(2.0)


def _share_of_kind(chunks: Column, kind: str) -> Column:
    return F.size(F.filter(chunks, lambda c: chunk_kind(c) == kind)) / F.nullif(F.size(chunks), F.lit(0))


def chunk_statistics(array: str | Column, prefix: str = "") -> dict[str, Column]:
    """Count, bytes and kinds of a text's chunks; null where there are none."""
    a = F.col(array) if isinstance(array, str) else array
    size = F.transform(a, lambda c: F.octet_length(c))
    n = F.nullif(F.size(a), F.lit(0))
    total = F.aggregate(size, F.lit(0), lambda x, y: x + y)
    out = {
        "chunk_count": F.size(a).cast("long"), "chunk_byte_total": total.cast("long"), "mean_chunk_bytes": total / n, "p50_chunk_bytes": array_median(size),
        "p90_chunk_bytes": F.when(n.isNotNull(), nearest_rank(size, 0.9)).cast("double"), "max_chunk_bytes": F.array_max(size).cast("long"),
    } | {f"chunk_type_share_{k}": _share_of_kind(a, k) for k in CHUNK_KINDS}
    return {prefix + k: v for k, v in out.items()}


def with_chunk_tokens(df: DataFrame, texts: dict[str, str], path: str | None = None) -> DataFrame:
    """``df`` plus, per prefix: chunks, tokens of each, and whether chunks tile the text and their tokens are those of the whole text."""
    fields = [f for p in texts for f in (
        T.StructField(f"{p}chunks", T.ArrayType(T.StringType())), T.StructField(f"{p}chunk_tokens", T.ArrayType(T.IntegerType())),
        T.StructField(f"{p}chunks_tile", T.BooleanType()), T.StructField(f"{p}chunk_tokens_match", T.BooleanType()))]

    def row(e, *values):  # noqa: ANN001, ANN002, ANN202
        import regex

        pattern = regex.compile(PATTERN)
        out = []
        for v in values:
            parts = pattern.findall(v or "")
            ids = [e.encode_ordinary(p) for p in parts]
            out += [parts, [len(i) for i in ids], "".join(parts) == (v or ""), [t for i in ids for t in i] == e.encode_ordinary(v or "")]
        return out

    return _over_batches(df.drop(*(f.name for f in fields)), list(texts.values()), fields, row, vocabulary_path(path))


def decoded_tokens(ids: str | Column, path: str | None = None, most: int = 32) -> Column:
    """The first ``most`` tokens as ``id:hex`` of their bytes, for audits; unknown ids show no bytes."""
    where = vocabulary_path(path)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def decode(s: pd.Series) -> pd.Series:
        e = encoding(where)

        def one(i: int) -> str:
            try:
                return f"{i}:{e.decode_single_token_bytes(int(i)).hex()}"
            except KeyError:
                return f"{i}:"

        return s.map(lambda a: None if a is None else [one(i) for i in a[:most]])

    return decode(ids)
