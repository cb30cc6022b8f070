"""Token budgets: tokens per document under a byte-pair tokenizer, and totals by source, language and domain.

A text is split into pieces by the tokenizer's pattern. Each partition sorts the
distinct pieces of a block of texts, which is a walk through their prefix trie, and
carries the exact tokenization state along: for each prefix, its last token and its
number of tokens. Each trie node is worked out once; its count then joins all
documents of the block that hold the piece. Nothing is shuffled but the totals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenizer import PATTERN, ship, shipped, vocabulary_path
from ..session import cut
from .fold import blocks

KEPT = 500_000  # counts of pieces that a worker keeps between blocks


class Counter:
    """Exact token counts of pieces under one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.reachable: dict[bytes, bool] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens by merging, lowest rank first: the definition, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: bytes) -> bool:
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = self.merged(token) == [token]
        return known

    def _beside(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens can be neighbours: their text merges into just these two."""
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[a, b] = self.merged(a + b) == [a, b]
        return known

    def walk(self, pieces: list[bytes]) -> Iterator[int]:
        """The token count of each of the sorted ``pieces``, keeping the state of the prefix shared with the piece before."""
        last: list[bytes] = [b""]
        count = [0]
        before = b""
        for p in pieces:
            n = min(len(p), len(before))
            shared = n if p[:n] == before[:n] else next(i for i in range(n) if p[i] != before[i])
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(p) + 1):
                for start in range(max(0, end - self.longest), end):
                    token = p[start:end]
                    if token in self.ranks and self._whole(token) and (start == 0 or self._beside(last[start], token)):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            before = p
            yield count[len(p)]

    def tokens(self, texts: list[str | None]) -> list[int]:
        """The token count of each text; null and empty text have none."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.counts}
        if len(self.counts) + len(new) > KEPT:
            self.counts = {}
            new = {p for pieces in split for p in pieces}
        coded = sorted((p.encode("utf-8", "surrogatepass"), p) for p in new)
        for (_, p), n in zip(coded, self.walk([b for b, _ in coded]), strict=True):
            self.counts[p] = n
        get = self.counts.__getitem__
        return [sum(map(get, pieces)) for pieces in split]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def with_tokens(df: DataFrame, text: str, out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` less ``text``, plus ``out``: the number of tokens of ``text`` (0 for null). A column named ``out`` is replaced."""
    name = ship(df.sparkSession, vocabulary_path(vocabulary))
    others = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shipped(name))
        for b in batches:
            texts, n = b.column(len(others)).to_pylist(), []
            for i, j in blocks(texts, 2_000_000):
                n += c.tokens(texts[i:j])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(n, pa.int64())], names=schema.names)

    return df.select(*others, text).mapInArrow(run, schema)


def language(text: str) -> Column:
    """ko, en, mixed or und, by the letters: a Hangul syllable weighs two Latin letters. What the table says of the language isn't trusted."""
    text = F.coalesce(F.col(text), F.lit(""))
    h, latin = 2 * F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    both = h + latin
    return F.when(both == 0, "und").when(h >= 0.75 * both, "ko").when(latin >= 0.75 * both, "en").otherwise("mixed")


def source_key(source: str) -> Column:
    """Spellings of one source that differ in blanks, marks or case have one key; null stays null."""
    return F.lower(F.regexp_replace(source, r"[\p{IsWhite_Space}\p{P}\p{Cf}]+", ""))


def document_budget(documents: DataFrame, vocabulary: str | None = None, doc: str = "doc_id", text: str = "text", source: str = "source", domain: str = "domain") -> DataFrame:
    """``source, language, domain, n_texts, tokens`` of the documents; each doc counts once.

    Spellings of a source are one, named by the commonest. Null sources and domains
    are groups of their own; rows with a null id are left out.
    """
    what = ("_key", "source", "language", "domain", "tokens")
    rows = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_d"), source_key(source).alias("_key"), F.col(source).alias("source"), language(text).alias("language"), F.col(domain).alias("domain"), F.col(text).alias("_text"))
    # Repeated ids are merged once their texts are mere numbers: no text is shuffled.
    once = with_tokens(rows, "_text").groupBy("_d").agg(F.max(F.struct(*what)).alias("m")).select("m.*")
    spelled = cut(once.groupBy("_key", "source", "language", "domain").agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("tokens")))
    names = spelled.groupBy("_key", "source").agg(F.sum("n_texts").alias("n")).groupBy("_key").agg(F.max_by("source", F.struct("n", "source")).alias("name"))
    totals = spelled.groupBy("_key", "language", "domain").agg(F.sum("n_texts").alias("n_texts"), F.sum("tokens").alias("tokens"))
    return totals.alias("t").join(names.alias("n"), F.col("t._key").eqNullSafe(F.col("n._key"))).select(F.col("n.name").alias("source"), "language", "domain", "n_texts", "tokens")


def latest(measured: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each key: that of the latest moment. Rows of the same moment: the one greatest by its columns."""
    best = F.max(F.struct(at, *columns)).alias("_m")
    return measured.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(f"_m.{c}" for c in columns))


def pair_budget(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """``logical_corpus, language, domain, n_texts, tokens`` of the pairs, from the lengths of their id lists (stored counts may disagree).

    A null id list counts as no text. Pairs that the registry lacks are left out.
    """
    # Lists are measured before anything is shuffled.
    sized = measured.select("pair_id", "measured_at", *(F.when(F.col(f"{s}_token_ids").isNotNull(), F.size(f"{s}_token_ids")).cast("long").alias(s) for s in ("ko", "en")))
    one = latest(sized, "pair_id", "measured_at", ["ko", "en"]).join(registry.select("pair_id", "logical_corpus", "domain"), "pair_id")
    per = one.groupBy("logical_corpus", "domain").agg(*(f(s).alias(f"{n}_{s}") for s in ("ko", "en") for n, f in (("n", F.count), ("t", F.sum))))
    sides = F.inline(F.array(*(F.struct(F.lit(s).alias("language"), F.col(f"n_{s}").alias("n_texts"), F.coalesce(f"t_{s}", F.lit(0)).alias("tokens")) for s in ("ko", "en"))))
    return per.select("logical_corpus", "domain", sides)
