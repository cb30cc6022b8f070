"""Text that looks the same in different characters: one consistent form of every text.

For each word the sets of scripts that its letters may stand for are intersected (``scripts``). Mixed words
are spelled in the script that has all their letters, words of one or two look-alikes alone, or tied to Latin
words or numbers, in Latin; other words wholly in another script stay. Width, ligature, blank and invisible
forms become the ordinary character, and everything is composed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import garble
from .scripts import LOOKALIKES, consistent, invisible, ordinary

# Texts of these characters alone are in the consistent form: ASCII, syllables, ideographs, composed accents less those that pass for other letters, typographic marks.
_PASSING = [c for c in map(chr, range(0xA1, 0x250)) if c not in LOOKALIKES and ordinary(c) == c and not invisible(c)]
# As ranges: the JVM is slow with a class of many single characters.
ACCENTED = "".join((c if chr(ord(c) - 1) not in _PASSING else "") + ("" if chr(ord(c) + 1) in _PASSING else f"-{c}") for c in _PASSING)
JVM_UNUSUAL = rf"[^\t\n\r -~가-힣一-丧丩-鿿{ACCENTED}‘’“”–—…€「」『』]"
SIDES = {"ko": "ko_text_nfc", "en": "en_text_nfc"}


def consistent_sides(df: DataFrame, key: str = "pair_id", sides: dict[str, str] = SIDES) -> DataFrame:
    """``<key>, side, text, consistent_text, reasons``: every text of ``df``; ``reasons`` is empty where it stays as it is.

    Null keys and null texts are left out; empty text stays empty. Only texts with an
    unusual character leave the JVM. Other columns are ignored.
    """
    texts = garble.long_sides(df, key, sides)
    schema = T.StructType([*texts.schema.fields, T.StructField("consistent_text", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, why = zip(*map(consistent, b.column(2).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string()), pa.array(why, pa.list_(pa.string()))], names=schema.names)

    unusual = F.col("text").rlike(JVM_UNUSUAL)
    plain = texts.where(~unusual).select("id", "side", "text", F.col("text").alias("consistent_text"), F.array().cast("array<string>").alias("reasons"))
    return plain.unionByName(texts.where(unusual).mapInArrow(run, schema)).withColumnRenamed("id", key)


def lookalike_sides(df: DataFrame, key: str = "pair_id", sides: dict[str, str] = SIDES, garbled_in: dict[str, str] = garble.SIDES) -> DataFrame:
    """``<key>, side``: the texts that their consistent form changes, less those that a wrong decoding has garbled."""
    changed = consistent_sides(df, key, sides).where(F.size("reasons") > 0).select(key, "side")
    return changed.join(garble.garbled_sides(df, key, garbled_in), [key, "side"], "left_anti").distinct()
