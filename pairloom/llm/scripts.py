"""Scripts of letters, letters that look alike across them, and the one consistent form of a text.

Each letter has a set of scripts that it may stand for: its own and those in which a letter looks like
it; ideographs count as Korean, Japanese and Chinese. The sets of a word's letters are intersected. Where
nothing of their own scripts is common, the word is mixed, and is spelled in a script that all its
letters have a spelling in.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from functools import lru_cache

import regex

# Letters of other scripts that look like a Latin letter, with that letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ү": "Y", "ү": "y", "Ԍ": "G", "ԍ": "g", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ό": "ó", "ί": "í", "ά": "á",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "զ": "q", "ա": "w", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲭ": "x", "Ⲍ": "Z",
    # Latin letters that pass for basic ones
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ſ": "s", "Ɩ": "l", "ǀ": "l",
}
# By rule: small capitals pass for the small letter in their name.
LOOKALIKES |= {chr(p): n[-1].lower() for p in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)) for n in [ud.name(chr(p), "")] if n[:-1] == "LATIN LETTER SMALL CAPITAL "}
# Greek letters that pass for Latin ones only loosely; they count in a mixed word, not in a whole word.
LOOSE = {"υ": "u", "χ": "x", "γ": "y", "ω": "w", "η": "n", "τ": "t", "σ": "o"}
# Strokes of other scripts that pass for a Latin letter inside a Latin word.
STROKES = {"ㅣ": "l", "丨": "l"}
# Katakana that pass for ideographs.
KANA = {"ロ": "口", "ニ": "二", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ハ": "八", "ー": "一"}
# Marks and blanks that pass for an ASCII mark.
MARKS = {"‐": "-", "‑": "-", "․": ".", "⁄": "/", "∕": "/", "∶": ":", "；": ";", "·": "·"}
# Characters without any ink that are not of category Cf.
BLANKLESS = frozenset("͏ᅟᅠ឴឵ㅤﾠ")


def invisible(c: str) -> bool:
    return c in BLANKLESS or ud.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


ALPHABETS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC")
ALPHABETIC = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}" + "".join(STROKES)
WORD = regex.compile(rf"[{ALPHABETIC}][{ALPHABETIC}\p{{Mn}}]*")
CJK = regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}\p{Hangul}ー]+")
KANA_LETTER = regex.compile(r"[\p{Katakana}\p{Hiragana}]")
# Characters without which a text has no letter to be respelled.
ODD = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯᲀ-ᲊⷠ-ⷿꙀ-ꚟ԰-֏Ꭰ-ᏽꭰ-ꮿⲀ-⳿぀-ヿㇰ-ㇿｦ-ﾝ" + "".join(re.escape(c) for c in (*LOOKALIKES, *STROKES)) + "]")
PICTURE = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}|[\U0001F3FB-\U0001F3FF]")
JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}\p{Thai}]")
BACK: dict[str, dict[str, str]] = {}  # letter of one script -> its spelling in another, by script


@lru_cache(100_000)
def script(c: str) -> str:
    """The alphabet of a letter, CJK for a stroke of STROKES, else nothing."""
    name = ud.name(c, "").split(" ")[0]
    return name if name in ALPHABETS else "CJK" if c in STROKES else ""


for _own, _latin in LOOKALIKES.items():
    if script(_own) != "LATIN":
        BACK.setdefault(script(_own), {}).setdefault(_latin, _own)


@lru_cache(100_000)
def spellings(c: str) -> dict[str, str]:
    """By script, the letter that looks like ``c`` in it: the keys are the scripts the letter may stand for."""
    out = {script(c): c}
    latin = c if script(c) == "LATIN" else LOOKALIKES.get(c) or LOOSE.get(c) or STROKES.get(c)
    if latin:
        out["LATIN"] = LOOKALIKES.get(latin, latin)
        out |= {s: m[latin] for s, m in BACK.items() if latin in m and s not in out}
    return out


@lru_cache(100_000)
def resolved(c: str) -> frozenset[str]:
    """The writing systems a letter of East Asian script may belong to."""
    name = ud.name(c, "")
    if c == "ー" or name.startswith(("KATAKANA", "HIRAGANA", "HALFWIDTH KATAKANA")):
        return frozenset(("Japanese",))
    return frozenset(("Korean",)) if "HANGUL" in name else frozenset(("Korean", "Japanese", "Chinese"))


@lru_cache(100_000)
def ordinary(c: str) -> str:
    """The ordinary character that a width, font, ligature, radical or blank form stands for, else the character."""
    if c in MARKS and c != "·":
        return MARKS[c]
    if ud.category(c) in ("Zs", "Zl", "Zp") or c == "\x85":
        return " "
    kind = ud.decomposition(c).split(" ")[0]
    wide = kind in ("<wide>", "<narrow>", "<font>", "<small>", "<vertical>", "<noBreak>", "<square>")
    form = kind == "<compat>" and ("⺀" <= c <= "⿕" or c == "№" or "ﬀ" <= c <= "ﬗ" or "Ⅰ" <= c <= "ⅿ" or "Ĳ" <= c <= "ĳ" or "Ǆ" <= c <= "ǳ" or "ſ" <= c <= "ſ")
    presented = kind in ("<initial>", "<medial>", "<final>", "<isolated>")
    return ud.normalize("NFKC", c) if wide or form or presented else c


def without_invisible(text: str) -> str:
    """The text less invisible characters; those that belong to emoji or to joining scripts stay, blank letters become blanks."""
    out, before = [], ""
    for i, c in enumerate(text):
        if c in "ㅤﾠᅠᅟ" and not ("ᄀ" <= text[i - 1 : i] <= "ᅞ" or "ᅡ" <= text[i + 1 : i + 2] <= "ᆧ"):
            out.append(" ")
            before = " "
            continue
        if not invisible(c) and not (ud.category(c) == "Cc" and c not in "\t\n\r\x85"):
            out.append(c)
            before = c
            continue
        after = text[i + 1 : i + 2]
        emoji = c == "‍" and PICTURE.match(before) and PICTURE.match(after) or c in "︎️" and (PICTURE.match(before) or before in "#*0123456789©®™" and before) or "\U000e0020" <= c <= "\U000e007f"
        if emoji or c in "‌‍" and JOINING.match(before) and JOINING.match(after):
            out.append(c)
    return "".join(out)


def respelled(text: str) -> str:
    """Each word in one script, as long as before.

    Words wholly in another script stay, but for look-alikes of one or two letters, those tied to a Latin word or a number,
    and those in a text that mixes their script into Latin words.
    """
    if text.isascii() or not ODD.search(text):
        return text
    words = [m[0] for m in WORD.finditer(text)]
    own = [{script(c) for c in w if script(c)} for w in words]
    genuine = {next(iter(s)) for w, s in zip(words, own, strict=True) if len(s) == 1 and s != {"LATIN"} and not all(c in LOOKALIKES for c in w)}
    mixing = set().union(*(s for s in own if "LATIN" in s))

    def one(m: regex.Match) -> str:
        w = m[0]
        if w.isascii():
            return w
        letters = [c for c in w if script(c)]
        if not letters:
            return w
        scripts = {script(c) for c in letters}
        if len(scripts) == 1 and "LATIN" not in scripts:
            if scripts & genuine or not all(c in LOOKALIKES for c in letters) or len(letters) > 2 and not scripts & mixing and not _tied(text, m.start(), m.end()):
                return w
            choice = "LATIN"
        else:
            options = set.intersection(*(set(spellings(c)) for c in letters))
            if not options:
                return w
            votes = Counter(script(c) for c in letters)
            choice = max(options, key=lambda s: (s == "LATIN" or s in genuine, votes[s], s == "LATIN"))
        return "".join(spellings(c).get(choice, c) if script(c) else c for c in w)

    out = WORD.sub(one, text)
    if not KANA_LETTER.search(out) and "ー" not in out:
        return out
    japanese = any(c not in KANA for c in KANA_LETTER.findall(out))

    def ideographs(m: regex.Match) -> str:
        w = m[0]
        kana = [c for c in w if resolved(c) == {"Japanese"}]
        han = any(len(resolved(c)) == 3 for c in w)
        mixed = not frozenset.intersection(*map(resolved, w))
        if not kana or not all(c in KANA for c in kana) or not (mixed and (han or "ー" not in kana) or han and not japanese):
            return w
        return "".join(KANA.get(c, c) for c in w)

    return CJK.sub(ideographs, out)


def _tied(text: str, start: int, end: int) -> bool:
    """Whether an ASCII letter or digit stands beside a word, or beyond a hyphen or apostrophe."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    ascii_word = lambda c: c.isascii() and c.isalnum()
    return ascii_word(before[-1:]) or ascii_word(after[:1]) or before[-1:] in "-'’‐‑" and ascii_word(before[:1]) or after[:1] in "-'’‐‑" and ascii_word(after[1:])


def consistent(text: str | None) -> tuple[str | None, list[str]]:
    """The text's consistent form, and why it differs."""
    if text is None:
        return None, []
    why, now = [], text
    for reason, step in (
        ("INVISIBLE", without_invisible),
        ("FORM", lambda t: "".join(map(ordinary, t))),
        ("DECOMPOSED", lambda t: ud.normalize("NFC", t)),
        ("SCRIPT", respelled),
    ):
        then = step(now)
        if then != now:
            why.append(reason)
        now = then
    return ud.normalize("NFC", now), why


def spelled(text: str) -> str:
    """The consistent form of a text that has a letter to be respelled, else the text: what is left of forms is folded by character."""
    return text if text.isascii() or not ODD.search(text) else consistent(text)[0]
