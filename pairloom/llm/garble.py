"""Text decoded with a wrong character encoding: find it, and give the original back where possible.

Every distinct clean word of the corpus is garbled under all chains of wrong
decodings; the table of garbled forms is hash-joined with the suspicious words of
the texts, and verified originals take their place. Where a word is unknown, the
same table holds forms of two neighbouring syllables and of single characters.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

ONE_BYTE = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")
# Chains of (written in, read as); a chain's name joins its steps.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", r),) for r in (*ONE_BYTE, "cp949", "gb18030", "gbk", "cp932", "big5")),
    *((("cp1252", r),) for r in ("utf-8", "mac_roman", "cp949")),
    *((("cp949", r),) for r in ("latin-1", "cp1252", "mac_roman", "utf-8", "gb18030", "cp932")),
    *((("utf-8", a), ("utf-8", b)) for a in ("latin-1", "cp1252") for b in ("latin-1", "cp1252")),
)
SIEVE_BITS = 22  # a fixed-size sieve of the suspicious words, so that forms nobody needs are not shuffled
HANGUL = "가-힣"
TYPOGRAPHIC = "‘’“”–—…€"
MARKS = TYPOGRAPHIC + "«»‹›「」『』°·¿¡•™®©" + "\u200d\ufe0f"  # may stand in clean text beside letters of any script
# A word can be garbled only if it has a character outside these, or a Latin letter beside a Hangul one.
PLAIN = rf"\x00-\x7f{HANGUL}{TYPOGRAPHIC}ᄀ-ᇿ！-～​-‏⁠-⁤﻿　ㅤ͏ -   "
SUSPICIOUS = re.compile(rf"[^{PLAIN}]|[A-Za-z][{HANGUL}]|[{HANGUL}][A-Za-z]")
MIXED = re.compile(rf"[A-Za-z][{HANGUL}]|[{HANGUL}][A-Za-z]")
JVM_SUSPICIOUS = r"[^\x00-\x7f가-힣‘’“”–—…€ᄀ-ᇿ！-～​-‏⁠-⁤﻿　ㅤ͏ -   ]|[A-Za-z][가-힣]|[가-힣][A-Za-z]"
TOKEN = re.compile(r"[^ \t\n\r]+")
EDGE = re.compile(r"^[!-/:-@\[-`{-~0-9]+|[!-/:-@\[-`{-~0-9]+$")
DIGITS = re.compile(r"[0-9][0-9,.]*")
NON_ASCII = re.compile(r"[^\x00-\x7f]")


CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
CP1252_BACK = {ord(c): b for b, c in CP1252.items()} | dict.fromkeys(CP1252, 0x100)  # what cp1252 writes otherwise can't be a control


def read_as(data: bytes, encoding: str) -> str:
    """Decode as careless software does: bytes cp1252 leaves undefined become control characters, other faults U+FFFD."""
    if encoding == "cp1252":
        return data.decode("latin-1").translate(CP1252)
    return data.decode(encoding, "replace")


def written(text: str, encoding: str) -> bytes:
    """The inverse of read_as; UnicodeError if there is none."""
    if encoding == "cp1252":
        return text.translate(CP1252_BACK).encode("latin-1")
    return text.encode(encoding)


def garbled(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain; null if it can't be written so or nothing changes."""
    out = text
    try:
        for w, r in chain:
            out = read_as(out.encode(w), r)
    except UnicodeError:
        return None
    return None if out == text or not NON_ASCII.search(out) else out


def restored(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The original of a garbled text, if the chain can be undone and leads back to the same garbled text."""
    if "�" in text:
        return None
    out = text
    try:
        for w, r in reversed(chain):
            out = written(out, r).decode(w)
    except UnicodeError:
        return None
    return out if garbled(out, chain) == text else None


def unit(token: str) -> str:
    """A token without ASCII marks and digits at its edges; digits inside it count as one 0."""
    return DIGITS.sub("0", EDGE.sub("", token))


def clean(u: str) -> bool:
    """Whether a unit may be an original: one script, letters and ordinary marks only."""
    kinds = set()
    for c in u:
        if c > "\x7f" and c not in MARKS and not (c >= "☀" and ud.category(c) in ("So", "Sk")):
            if "가" <= c <= "힣":
                kinds.add("H")
            elif "一" <= c <= "鿿":
                kinds.add("C")
            elif ud.category(c)[0] == "L" and c < "ˀ":
                kinds.add("L")
            elif "Ͱ" <= c <= "ӿ" and ud.category(c)[0] == "L":
                kinds.add("G" if c < "Ѐ" else "K")
            else:
                return False
    return (len(kinds) <= 1 or kinds == {"H", "C"} and "(" in u) and not MIXED.search(u)


def pieces(units: dict[str, int]) -> Iterator[tuple[str, str, int]]:
    """Pieces of clean units: the unit, its pairs of Hangul syllables, its single characters outside ASCII."""
    pairs: Counter = Counter()
    single: Counter = Counter()
    for u, n in units.items():
        yield "word", u, n
        for a, b in zip(u, u[1:], strict=False):
            if "가" <= a <= "힣" and "가" <= b <= "힣":
                pairs[a + b] += n
        for c in u:
            if c > "\x7f":
                single[c] += n
    yield from (("pair", p, n) for p, n in pairs.items())
    yield from (("char", c, n) for c, n in single.items())


def forms_of(kind: str, piece: str) -> Iterator[tuple[str, int]]:
    """Garbled forms of a piece with the number of the chain."""
    seen = set()
    for k, chain in enumerate(CHAINS):
        if kind == "char" and not (chain[0][0] == "utf-8" and all(r in ONE_BYTE for _, r in chain) or chain[-1][1] == "utf-8"):
            continue  # short forms of other chains also occur in clean text
        f = garbled(piece, chain)
        if f is None or f in seen or chain[0][0] != "utf-8" and chain[-1][1] == "utf-8" and "�" not in f:
            continue  # what reads well as UTF-8 is garbling undone
        if kind == "char" and len(f) < 2 and f != "�" or kind == "pair" and (len(f) < 3 and "�" not in f or len(NON_ASCII.findall(f)) < 2):
            continue
        seen.add(f)
        yield f, k


def _bit(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> (64 - SIEVE_BITS)


PIECE_SIZES = range(1, 10)


def _cuts(u: str) -> set[str]:
    """Substrings of a suspicious unit that could be the form of a pair or a character."""
    return {u[i : i + n] for n in PIECE_SIZES for i in range(len(u) - n + 1) if u[i] > "\x7f" and u[i + n - 1] > "\x7f" and (n > 1 or u[i] == "�")}


def clean_pieces(texts: DataFrame) -> DataFrame:
    """``kind, piece, n``: distinct pieces of the clean units in column ``text``, counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = list(pieces({u: n for u, n in units.items() if clean(u)}))
            units.clear()
            return pa.RecordBatch.from_pylist([{"kind": k, "piece": p, "n": n} for k, p, n in rows], schema=pa.schema([("kind", pa.string()), ("piece", pa.string()), ("n", pa.int64())]))

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    units.update(unit(x) for x in t.split() if not x.isascii())
            if len(units) > 200_000:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "kind string, piece string, n long").where("piece <> ''").groupBy("kind", "piece").agg(F.sum("n").alias("n"))


def _suspects(texts: DataFrame) -> DataFrame:
    """``id, side, copy, unit, plain``: units that may be garbled, once for each text; ``copy`` is the same for texts that differ in blanks, case and ASCII marks only, ``plain``: the unit may also be a genuine word."""
    schema = T.StructType([texts.schema["id"], texts.schema["side"], T.StructField("copy", T.LongType()), T.StructField("unit", T.StringType()), T.StructField("plain", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, units = [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                own = {unit(x) for x in TOKEN.findall(t) if not x.isascii() and SUSPICIOUS.search(x)} - {""}
                rows += [i] * len(own)
                units += own
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows, pa.int32())) for c in (0, 1, 2)), pa.array(units, pa.string()), pa.array(map(clean, units), pa.bool_())], names=schema.names)

    copy = F.xxhash64("side", F.lower(F.regexp_replace("text", r"[\s\p{Punct}]+", ""))).alias("copy")
    return texts.where(F.col("text").rlike(JVM_SUSPICIOUS)).select("id", "side", copy, "text").mapInArrow(run, schema)


def _forms(known: DataFrame, sieve: object, kinds: tuple[str, ...]) -> DataFrame:
    """``form, kind, original, chain, n``: the table of garbled forms, less those that the sieve of suspicious strings can't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for b in batches:
            rows = []
            for kind, piece, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for f, k in forms_of(kind, piece):
                    if bits[_bit(f)]:
                        rows.append((f, kind, piece, k, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["form", "kind", "original", "chain", "n"])

    # Few bytes, much work: spread over all cores, however small the table.
    spark = known.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return known.where(F.col("kind").isin(*kinds)).select("kind", "piece", "n").repartition(parts, "piece").mapInArrow(run, "form string, kind string, original string, chain int, n long")


def _sieve(strings: DataFrame, column: str) -> object:
    """A bit for each string, in an array of fixed size that the driver may hold and broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for b in batches:
            for s in b.column(0).to_pylist():
                bits[_bit(s)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits).astype(np.int32))], names=["bit"])

    out = np.zeros(1 << SIEVE_BITS, bool)
    out[strings.select(column).mapInArrow(run, "bit int").distinct().toArrow()["bit"].to_numpy()] = True
    return strings.sparkSession.sparkContext.broadcast(out)


def garbled_units(texts: DataFrame) -> DataFrame:
    """``id, side, unit, original, chain, sure``: each unit of each text that is a garbled form, with its commonest original.

    ``texts`` has ``id, side, text``. ``sure``: it is the form of one known word only.
    """
    known = cut(clean_pieces(texts))
    spots = cut(_suspects(texts))
    units = cut(spots.groupBy("unit").agg(F.count_distinct("copy").alias("times"), F.bool_or("plain").alias("plain")))
    # Whole words first.
    forms = _forms(known, _sieve(units, "unit"), ("word",))
    matches = cut(units.join(forms.withColumnRenamed("form", "unit"), "unit").where("unit <> original"))
    best = lambda d, *by: d.groupBy("unit", *by).agg(F.max_by(F.struct("original", "chain"), F.struct("n", "original", F.negative("chain"))).alias("best"), (F.count_distinct("original") == 1).alias("sure"))
    # What reads like a word is garbled if it stands in no more texts, copies aside, than the word itself.
    words = cut(best(matches.where("times <= n or not plain")).select("unit", "best.original", "best.chain", "sure"))
    # Words that nobody wrote correctly: by the forms of their parts.
    parts = cut(units.join(words, "unit", "left_anti").select("unit").mapInArrow(_part_rows, "part string, unit string"))
    part_forms = _forms(known, _sieve(parts, "part"), ("pair", "char"))
    by_part = parts.join(part_forms.withColumnRenamed("form", "part"), "part").groupBy("unit").agg(F.max_by("chain", F.struct(F.length("part"), "n", F.negative("chain"))).alias("chain"))
    found = words.unionByName(by_part.select("unit", F.lit(None).cast("string").alias("original"), "chain", F.lit(False).alias("sure")))
    here = spots.join(found, "unit").select("id", "side", "unit", "original", "chain", "sure")
    # A commoner one is garbled where the same text holds another form of the same chain.
    doubtful = best(matches.join(words, "unit", "left_anti").where(~F.contains("unit", F.lit("�"))), "chain").select("unit", "best.original", "chain", "sure")
    there = cut(spots.join(doubtful, "unit").select("id", "side", "unit", "original", "chain", "sure"))
    keys = there.select("id", "side", "chain").distinct()
    shown = here.select("id", "side", "chain", "unit").join(keys, ["id", "side", "chain"], "left_semi").unionByName(there.select("id", "side", "chain", "unit"))
    backed = shown.groupBy("id", "side", "chain").agg(F.count_distinct("unit").alias("_n")).where("_n > 1").drop("_n")
    seconded = cut(
        there.join(backed, ["id", "side", "chain"], "left_semi").groupBy("id", "side", "unit").agg(F.min_by(F.struct("original", "chain", "sure"), "chain").alias("m")).select("id", "side", "unit", "m.original", "m.chain", "m.sure")
    )
    return here.join(seconded, ["id", "side", "unit"], "left_anti").unionByName(seconded)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(c, u) for u in b.column(0).to_pylist() for c in _cuts(u)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["part", "unit"])


def long_sides(df: DataFrame, key: str, sides: dict[str, str]) -> DataFrame:
    """``id, side, text``: one row for each row and side of ``df``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in sides.items())))
    return df.select(F.col(key).alias("id"), pairs.alias("_s")).select("id", "_s.side", "_s.text").where("id is not null and text is not null")


SIDES = {"ko": "ko_text_analysis", "en": "en_text_analysis"}


def garbled_sides(df: DataFrame, key: str = "pair_id", sides: dict[str, str] = SIDES) -> DataFrame:
    """``<key>, side``: the texts of ``df`` that a wrong decoding has garbled, wholly or in a stretch.

    Null keys and null or empty texts are no cases. Other columns are ignored; an empty table gives no rows.
    """
    return garbled_units(long_sides(df, key, sides)).select(F.col("id").alias(key), "side").distinct()


def repaired_sides(df: DataFrame, key: str = "pair_id", sides: dict[str, str] = SIDES) -> DataFrame:
    """``<key>, side, chain, garbled_text, restored_text, complete`` of each garbled text.

    Words in the table become their verified originals; other suspicious words are
    decoded back along the chain that the text's known words show, if that leads back
    to the same bytes. ``complete``: no suspicious word is left and none was ambiguous.
    """
    texts = long_sides(df, key, sides)
    per_text = garbled_units(texts).groupBy("id", "side").agg(F.collect_list(F.struct("unit", "original", "chain", "sure")).alias("units"))

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("complete", T.BooleanType()), T.StructField("chain", T.StringType())]))
    def mend(text, units):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([mended(t, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in u]) for t, u in zip(text, units, strict=True)], columns=["text", "complete", "chain"])

    # Only suspicious texts are moved: no other has garbled units.
    some = texts.where(F.col("text").rlike(JVM_SUSPICIOUS))
    return some.join(per_text, ["id", "side"]).withColumn("m", mend("text", "units")).select(
        F.col("id").alias(key), "side", "m.chain", F.col("text").alias("garbled_text"), F.col("m.text").alias("restored_text"), "m.complete"
    )


def mended(text: str, units: list[tuple]) -> tuple[str, bool, str]:
    """The text with its garbled tokens put right; whether all are; the commonest chain."""
    known = {u: (o, k, sure) for u, o, k, sure in units}
    ranked = [k for k, _ in Counter(k for _, k, _ in known.values()).most_common()]
    whole = True

    def right(m: re.Match) -> str:
        nonlocal whole
        token, u = m[0], unit(m[0])
        if u not in known and (token.isascii() or not SUSPICIOUS.search(token)):
            return token
        if u not in known and clean(u):  # a foreign word, unless the text's own chain makes it Korean
            back = restored(token, CHAINS[ranked[0]]) if ranked else None
            return back if back and clean(unit(back)) and re.search(f"[{HANGUL}]", back) else token
        original, _, sure = known.get(u, (None, 0, False))
        if not sure:
            for k in ranked:
                if (back := restored(token, CHAINS[k])) is not None:
                    return back
        whole &= bool(sure)
        if original is None:
            return token
        core = EDGE.sub("", token)
        digits = iter(DIGITS.findall(core))
        at = token.index(core)
        return token[:at] + re.sub("0", lambda _: next(digits, "0"), original) + token[at + len(core) :]

    return TOKEN.sub(right, text), whole, " > ".join(f"{w} read as {r}" for w, r in CHAINS[ranked[0]]) if ranked else ""
