"""One consistent form for text in which equal-looking text is equal.

Most text is stable: it holds no character that any of the rules could change. The quick check is one
regular expression over a class of unstable characters, built at import from the Unicode database by rule.
Only the unstable segments, each with the character before it as boundary context, are rewritten, and
the results are spliced into the unchanged rest. The quick check itself runs in the JVM, so that
stable rows (plain ASCII) never travel to Python.

Changed: full-width, half-width, styled and ligature forms; letters followed by combining marks that have a single-character
form; invisible characters; spaces other than U+0020; letters of another script (and script-like Latin
ones) that imitate Latin letters inside an otherwise Latin word. Unchanged: composed letters, curly quotes, dashes,
superscripts, whole words of another script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that look like Latin ones, by script.
IMITATIONS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "ү": "y", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Һ": "h",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ϱ": "p",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "յ": "j", "զ": "q", "ց": "g", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin letters of phonetic scripts
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɪ": "i",
}
LATIN_IMITATIONS = frozenset(c for c in IMITATIONS if unicodedata.name(c).startswith("LATIN"))
FOLDED_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Blank or zero-width, though their category doesn't say so.
INVISIBLE_EXTRA = frozenset("͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ⠀") | frozenset(map(chr, range(0xFE00, 0xFE10)))


def _invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind == "Cf" or c in INVISIBLE_EXTRA or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85")


def _space(c: str) -> bool:
    return c != " " and unicodedata.category(c) in ("Zs", "Zl", "Zp")


def _folded(c: str) -> str:
    """c without its width, style or ligature; other compatibility forms (superscripts, fractions) stay."""
    d = unicodedata.decomposition(c)
    if d.startswith(FOLDED_TAGS) or (d.startswith("<compat>") and 0xFB00 <= ord(c) <= 0xFB4F):
        return unicodedata.normalize("NFKC", c)
    return c


def _unstable(c: str) -> bool:
    """Not 'yes' in the quick check: c may change, or may combine with the character before it."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs"):
        return False
    if unicodedata.decomposition(c) and (_folded(c) != c or unicodedata.normalize("NFC", c) != c):
        return True
    return _invisible(c) or _space(c) or bool(unicodedata.combining(c)) or 0x1161 <= ord(c) <= 0x1175 or 0x11A8 <= ord(c) <= 0x11C2


def _class(chars: list[int]) -> str:
    runs, out = [], []
    for c in chars:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    for a, b in runs:
        out.append(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else ""))
    return "".join(out)


#: All of Unicode but surrogates; the planes left out have no assigned characters, or only private ones.
_SCANNED = [*range(0, 0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xF0000)]
_UNSTABLE_CLASS = _class([i for i in _SCANNED if _unstable(chr(i))])
SEGMENT = re.compile(f"[^{_UNSTABLE_CLASS}]?[{_UNSTABLE_CLASS}]+")
# the same for texts of the basic plane, in which a character is looked up in a table instead of among ranges
_BASIC_CLASS = _class([i for i in _SCANNED if i < 0x10000 and _unstable(chr(i))])
_BASIC_SEGMENT = re.compile(f"[^{_BASIC_CLASS}]?[{_BASIC_CLASS}]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_IMITATION = re.compile(f"[{''.join(IMITATIONS)}]")
IMITATION_WORD = re.compile(f"[^\\W\\d_]*[{''.join(IMITATIONS)}][^\\W\\d_]*")
MARK = re.compile(f"[{_class([i for i in _SCANNED if unicodedata.combining(chr(i))])}]")
_TO_LATIN = str.maketrans(IMITATIONS)
#: What the JVM looks for: rows without such a character are stable.
JVM_QUICK_CHECK = r"[^\x09-\x0d\x20-\x7e]"


_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def _stable(text: str) -> bool:
    """The quick check: plain ASCII without control characters."""
    return text.isascii() and (text.isprintable() or not _CONTROL.search(text))


def _canonical(segment: str) -> str:
    kept = "".join(" " if _space(c) else _folded(c) for c in segment if not _invisible(c))
    return unicodedata.normalize("NFC", kept)


def _latin_word(word: str) -> str:
    """The word with imitations replaced, if all its other letters are Latin and it has one."""
    latin = False
    for c in word:
        if c in IMITATIONS and c not in LATIN_IMITATIONS:
            continue
        if c.isascii() or unicodedata.name(c, "").startswith("LATIN"):
            latin = True
        else:
            return word
    return word.translate(_TO_LATIN) if latin else word


def _segments(text: str) -> re.Pattern:
    return SEGMENT if _BEYOND.search(text) else _BASIC_SEGMENT


def consistent(text: str | None) -> str | None:
    """The consistent form of text; None stays None, and the result is a fixed point."""
    if text is None or _stable(text):
        return text
    out = _segments(text).sub(lambda m: _canonical(m.group()), text)
    latin = IMITATION_WORD.sub(lambda m: _latin_word(m.group()), out) if _IMITATION.search(out) else out
    # a mark that fitted no imitation may fit the letter that took its place
    return consistent(latin) if latin != out and MARK.search(latin) else latin


def consistent_with_offsets(text: str) -> tuple[str, list[int] | None]:
    """The consistent form, and for each of its characters the offset in text it came from (None: the same)."""
    if _stable(text):
        return text, None
    parts: list[str] = []
    at: list[int] = []
    last = 0
    for m in _segments(text).finditer(text):
        a, b = m.span()
        parts.append(text[last:a])
        at.extend(range(last, a))
        seg = _canonical(m.group())
        parts.append(seg)
        at.extend(min(a + k, b - 1) for k in range(len(seg)))
        last = b
    parts.append(text[last:])
    at.extend(range(last, len(text)))
    out = "".join(parts)
    latin = IMITATION_WORD.sub(lambda m: _latin_word(m.group()), out) if _IMITATION.search(out) else out  # keeps the length
    if latin != out and MARK.search(latin):
        whole, more = consistent_with_offsets(latin)
        return whole, at if more is None else [at[i] for i in more]
    return latin, at


@F.pandas_udf(StringType())
def _consistent_udf(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield pd.Series([consistent(x) for x in s], index=s.index, dtype=object)


def is_suspect(col: Column) -> Column:
    """The quick check in the JVM: false means that the text is in the consistent form already."""
    return F.coalesce(col.rlike(JVM_QUICK_CHECK), F.lit(False))


def consistent_col(col: Column) -> Column:
    """col in the consistent form; only suspect rows carry their text to Python."""
    return F.coalesce(_consistent_udf(F.when(is_suspect(col), col)), col)


def with_consistent(df: DataFrame, column: str, to: str) -> DataFrame:
    """df plus column `to`, the consistent form of `column`. Null stays null, empty stays empty."""
    return df.withColumn(to, consistent_col(F.col(column)))


def deceptive_records(df: DataFrame, key: str, column: str, field_name: str) -> DataFrame:
    """(field_name, key), once for each key whose column holds a character that the consistent form changes.

    Null and stable texts are dropped before anything is shuffled; repeated rows come out once.
    """
    suspect = df.where(F.col(key).isNotNull() & is_suspect(F.col(column))).select(F.col(key).alias("__k"), F.col(column).alias("__t"))
    found = suspect.where(~_consistent_udf(F.col("__t")).eqNullSafe(F.col("__t")))
    return found.select(F.lit(field_name).alias("field_name"), F.col("__k").alias(key)).distinct()


def word_runs(text: str) -> list[str]:
    """Maximal runs of letters or digits, lower-cased."""
    return WORD.findall(text.lower())


WORD = re.compile(r"[^\W_]+")
_PUNCTUATION, _DIGITS, _BLANKS = re.compile(r"[^\w\s]"), re.compile(r"\d+"), re.compile(r"\s+")


def folded(text: str | None) -> str | None:
    """The form near-duplicates are compared in: consistent, lower case, no punctuation, # for each number."""
    if text is None:
        return None
    t = _PUNCTUATION.sub("", consistent(text).lower())
    return _BLANKS.sub(" ", _DIGITS.sub("#", t)).strip()
