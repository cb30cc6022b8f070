"""Morpheme features over a given analysis, and a slot for an analyzer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Tags of derivational affixes.
AFFIX_TAGS = ("XSN", "XSV", "XSA")
SEQUENCE_TYPE = "array<struct<form:string,pos:string>>"


def base_tag(tag: Column) -> Column:
    """The tag without the suffix of irregular forms."""
    return F.split_part(tag, F.lit("-"), F.lit(1))


def tag_class(tag: Column) -> Column:
    """particle, ending, deriv_affix or null."""
    b = base_tag(tag)
    return F.when(b.startswith("J"), "particle").when(b.startswith("E"), "ending").when(b.isin(*AFFIX_TAGS), "deriv_affix")


def morph_features(sequence: str = "morpheme_sequence", eojeols: str = "eojeol_count") -> dict[str, Column]:
    """Counts, density, ratios and warning of a sequence. Ratios over no morphemes are null; so is density over no eojeols."""
    seq = F.col(sequence)
    n = F.size(seq).cast("long")
    of = lambda kind: F.size(F.filter(seq, lambda m: tag_class(m["pos"]) == kind)).cast("long")
    particle, ending, affix = of("particle"), of("ending"), of("deriv_affix")
    ratio = lambda x: x / F.nullif(n, F.lit(0))
    return {
        "morpheme_count": n, "particle_count": particle, "ending_count": ending, "deriv_affix_count": affix,
        "morpheme_density": n / F.nullif(F.col(eojeols), F.lit(0)),
        "particle_ratio": ratio(particle), "ending_ratio": ratio(ending), "deriv_affix_ratio": ratio(affix), "function_morpheme_ratio": ratio(particle + ending),
        "analysis_warning_flag": n == 0, "analysis_warning_reason": F.when(n == 0, "ZERO_MORPHEME_OUTPUT").otherwise("NONE"),
    }


def scalar_features(sequence: list[tuple[str, str]], eojeols: int | None) -> dict[str, object]:
    """The features of one sequence of (form, tag), one by one: what the expressions of ``morph_features`` must equal."""
    count = dict.fromkeys(("particle", "ending", "deriv_affix"), 0)
    for _, tag in sequence:
        base = tag.partition("-")[0]
        kind = "particle" if base.startswith("J") else "ending" if base.startswith("E") else "deriv_affix" if base in AFFIX_TAGS else None
        if kind:
            count[kind] += 1
    n = len(sequence)
    part = lambda x: x / n if n else None
    return {
        "morpheme_count": n, **{f"{k}_count": v for k, v in count.items()}, "morpheme_density": n / eojeols if eojeols else None, **{f"{k}_ratio": part(v) for k, v in count.items()},
        "function_morpheme_ratio": part(count["particle"] + count["ending"]), "analysis_warning_flag": n == 0, "analysis_warning_reason": "NONE" if n else "ZERO_MORPHEME_OUTPUT",
    }


SCALAR_SCHEMA = "morpheme_count long, particle_count long, ending_count long, deriv_affix_count long, morpheme_density double, particle_ratio double, ending_ratio double, deriv_affix_ratio double, function_morpheme_ratio double, analysis_warning_flag boolean, analysis_warning_reason string"


def with_scalar_features(df: DataFrame, key: str, sequence: str = "morpheme_sequence", eojeols: str = "eojeol_count") -> DataFrame:
    """``key`` and the features by ``scalar_features``: the slow path, for gates and tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scalar_features([(m["form"], m["pos"]) for m in s or []], e) for s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in schema.fields[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    schema = T.StructType([df.schema[key], *T._parse_datatype_string(SCALAR_SCHEMA).fields])
    return df.select(key, sequence, eojeols).mapInArrow(run, schema)


Analyzer = Callable[[list[str]], list[list[tuple[str, str]]]]


def analyze(df: DataFrame, key: str, text: str, make: Callable[[], Analyzer]) -> DataFrame:
    """``key, morpheme_sequence``: texts through an analyzer that each Python worker makes once; it takes a batch and keeps its order."""
    cache: dict[str, Analyzer] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyzer = cache.setdefault("one", make()) if not cache else cache["one"]
        for b in batches:
            found = analyzer(b[text].fillna("").tolist())
            yield pd.DataFrame({key: b[key], "morpheme_sequence": [[{"form": f, "pos": p} for f, p in m] for m in found]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, morpheme_sequence {SEQUENCE_TYPE}")
