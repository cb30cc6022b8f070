"""Text features as JVM expressions: counts by character class, scripts, flags, normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the surface features.
HANGUL, LATIN, DIGIT, PUNCT, SPACE = r"\p{IsHangul}", r"\p{IsLatin}", r"\p{Nd}", r"\p{P}", r"\p{IsWhite_Space}"
URL = r"(?i)(?:https?://|www\.)\S+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CODE_LIKE = r"(?i)[{};]|=>|\b(?:function|def|import|class|return|const|let|var)\b|\w+\([^)]*\)"
CODE_ALTERNATIVES = {"brace_or_semicolon": r"[{};]", "arrow": r"=>", "keyword": r"(?i)\b(?:function|def|import|class|return|const|let|var)\b", "call": r"(?U)\w+\([^)]*\)"}
# Ranges of Extended_Pictographic.
EMOJI = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}\x{231A}-\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}"
    r"\x{2733}-\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B07}"
    r"\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}-\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}"
    r"\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]"
)
# Patterns of the raw-noise flags.
HTML_LIKE = r"<[A-Za-z/!][^>\n]{0,200}>"
URL_LIKE = r"(?i)\b(?:https?://|www\.)\S+"
EMAIL_LIKE = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_LIKE = r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ZERO_WIDTH = r"[​‌‍⁠﻿]"
EXPECTED = {"ko": r"[가-힣ㄱ-ㅎㅏ-ㅣ]", "en": r"[A-Za-z]"}


def count(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _normalizer(form: str):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normalize


def nfc(text: str | Column) -> Column:
    """NFC; Latin-1 texts, syllables and ideographs alone never leave the JVM, as they are in NFC."""
    return F.when(_col(text).rlike(r"[^\x00-ÿ가-힣一-鿿‐-‧]"), _normalizer("NFC")(text)).otherwise(_col(text))


def nfkc_changes(text: str | Column) -> Column:
    """Whether NFKC would change the text."""
    return F.when(_col(text).rlike(r"[^\x00-\x7f가-힣一-鿿]"), _normalizer("NFKC")(text) != _col(text)).otherwise(False)


def strip_edge_bom(text: str | Column) -> Column:
    return F.regexp_replace(text, "^﻿+|﻿+$", "")


def outer_trim(text: str | Column) -> Column:
    """As Python's strip: all white space at the edges, tabs, newlines and Unicode blanks too."""
    return F.regexp_replace(text, rf"^[{SPACE}\x1c-\x1f]+|[{SPACE}\x1c-\x1f]+$", "")


def outer_trim_spaces(text: str | Column) -> Column:
    """The SQL form of the trim: plain spaces only."""
    return F.trim(text)


def analysis_text(text: str | Column) -> Column:
    """NFC, then byte-order marks off the edges, then white space."""
    return outer_trim(strip_edge_bom(nfc(text)))


def anomaly_reasons(raw: str | Column) -> Column:
    """Reasons why a raw text is unusual: INTERNAL_ZERO_WIDTH, CONTROL_CHARACTER, ORPHAN_COMBINING_MARK, in this order."""
    reasons = F.array(
        F.when(strip_edge_bom(raw).rlike(r"[​‌‍﻿]"), "INTERNAL_ZERO_WIDTH"),
        F.when(_col(raw).rlike(r"[\p{Cc}&&[^\t\n]]"), "CONTROL_CHARACTER"),
        F.when(_col(raw).rlike(rf"(?:^|[{SPACE}])\p{{Mn}}"), "ORPHAN_COMBINING_MARK"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def segments(text: str | Column) -> Column:
    """Pieces between white space, empty ones aside: eojeols or words."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda x: x != "")


def segment_count(text: str | Column) -> Column:
    return F.size(segments(text)).cast("long")


def script_sequence(text: str | Column) -> Column:
    """The text as one letter a character: H Hangul, L Latin, O other; digits, marks and blanks drop out."""
    t = F.regexp_replace(text, rf"[[\p{{Nd}}\p{{P}}{SPACE}]&&[^{HANGUL}{LATIN}]]", "")
    # Private-use marks stand for the classes; private characters of the text itself are "other" and go first.
    h, latin, o = (chr(0xE001 + k) for k in range(3))
    t = F.regexp_replace(t, rf"[^{HANGUL}{LATIN}]", o)
    t = F.regexp_replace(F.regexp_replace(t, rf"[{HANGUL}]", h), rf"[{LATIN}]", latin)
    return F.translate(t, h + latin + o, "HLO")


def side_features(text: str | Column, prefix: str = "") -> dict[str, Column]:
    """The surface features of one side. Ratios are null for empty text."""
    t = _col(text)
    cp, size = F.length(t).cast("long"), F.octet_length(t).cast("long")
    graphemes = count(t, r"\X")
    hangul, latin = count(t, HANGUL), count(t, LATIN)
    rest = f"&&[^{HANGUL}{LATIN}]]"
    digit = count(t, rf"[{DIGIT}{rest}")
    punct = count(t, rf"[{PUNCT}&&[^{HANGUL}{LATIN}{DIGIT}]]")
    space = count(t, rf"[{SPACE}]")
    other = cp - hangul - latin - digit - punct - space
    seq = script_sequence(t)
    share = lambda n: n / F.nullif(cp, F.lit(0))
    out = {
        "codepoint_count": cp, "grapheme_count": graphemes, "utf8_bytes": size,
        "bytes_per_codepoint": share(size), "bytes_per_grapheme": size / F.nullif(graphemes, F.lit(0)),
        "whitespace_count": space, "whitespace_density": share(space), "space_run_count": count(t, rf"[{SPACE}]+"),
        "hangul_share": share(hangul), "latin_share": share(latin), "digit_share": share(digit), "punctuation_share": share(punct), "symbol_other_share": share(other),
        "script_type_count": sum((F.contains(seq, F.lit(x)).cast("long") for x in "HLO"), F.lit(0)),
        "script_switch_count": count(seq, "(?<=H)[LO]|(?<=L)[HO]|(?<=O)[HL]"),
        "url_flag": t.rlike(URL), "email_flag": t.rlike(EMAIL), "emoji_flag": t.rlike(EMOJI), "code_like_flag": t.rlike(CODE_LIKE),
    }
    return {prefix + k: v for k, v in out.items()}


def pair_features() -> dict[str, Column]:
    """Features of a pair, from columns of both sides' features."""
    ratio = lambda c: F.col(f"ko_{c}") / F.nullif(F.col(f"en_{c}"), F.lit(0))
    return {
        "pair_codepoint_ratio": ratio("codepoint_count"),
        "pair_grapheme_ratio": ratio("grapheme_count"),
        "pair_byte_ratio": ratio("utf8_bytes"),
        "pair_codepoint_diff": F.col("ko_codepoint_count") - F.col("en_codepoint_count"),
    }


def noise_flags(text: str | Column, language: str) -> dict[str, Column]:
    """The thirteen raw-noise flags of a text."""
    t = _col(text)
    return {
        "empty": outer_trim(t) == "", "leading_or_trailing_whitespace": outer_trim(t) != t, "repeated_whitespace": t.rlike(r"[ \t]{2,}"), "newline_or_tab": t.rlike(r"[\n\r\t]"),
        "html_like": t.rlike(HTML_LIKE), "url_like": t.rlike(URL_LIKE), "email_like": t.rlike(EMAIL_LIKE), "phone_like": t.rlike(PHONE_LIKE),
        "control_character": t.rlike(CONTROL), "zero_width": t.rlike(ZERO_WIDTH), "replacement_character": F.contains(t, F.lit("�")),
        "expected_script_absent": (F.length(t) > 0) & ~t.rlike(EXPECTED[language]), "nfkc_change": nfkc_changes(t),
    }


def code_alternatives(text: str | Column) -> dict[str, Column]:
    """Which alternatives of the code-like pattern match."""
    return {k: _col(text).rlike(p) for k, p in CODE_ALTERNATIVES.items()}


def scalar_text(number: str | Column) -> Column:
    """A number as a worksheet shows it: whole ones without a fraction; null stays null."""
    n = _col(number)
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def is_finite(x: str | Column) -> Column:
    """Not null, NaN or infinite."""
    x = _col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def mapped(value: str | Column, table: dict[str, str]) -> Column:
    """A label by lookup; unknown labels give null, for ``operators.validate.unmapped`` to find."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[_col(value)] if table else F.lit(None).cast("string")
