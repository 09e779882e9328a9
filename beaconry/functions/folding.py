"""Comparable forms of text: wrongly decoded letters, case and diacritics folded.

All tables are built from rules of Unicode and the two one-byte encodings that
UTF-8 is usually mistaken for, not listed.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, and the letter they fold to.
PLAIN = {"æ": "a", "ø": "o", "ß": "s", "ð": "d", "þ": "t", "đ": "d", "ł": "l", "ı": "i", "œ": "o", "ħ": "h", "ŧ": "t"}


def base_letter(letter: str) -> str:
    """The lower-case letter without diacritics, itself when it has none."""
    lower = letter.lower()[:1]
    return PLAIN.get(lower, unicodedata.normalize("NFD", lower)[0])


@functools.cache
def folding_tables() -> tuple[str, str]:
    """Source and target of a translate() over the Latin letters up to U+024F."""
    source = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and base_letter(c) != c]
    return "".join(source), "".join(base_letter(c) for c in source)


@functools.cache
def misreadings() -> tuple[tuple[str, str], ...]:
    """(letter as misread, letter) of U+00C0..U+00FF, for both one-byte encodings."""
    pairs = {}
    for letter in map(chr, range(0xC0, 0x100)):
        if letter.isalpha():
            for encoding in ("latin-1", "cp1252"):
                try:
                    pairs[letter.encode("utf-8").decode(encoding)] = letter
                except UnicodeDecodeError:
                    continue
    return tuple(sorted(pairs.items()))


@functools.cache
def _misread_patterns() -> tuple[tuple[str, str], ...]:
    """One pattern per base letter, whatever the case of the misread lead byte."""
    seconds: dict[str, list[str]] = {}
    for misread, letter in misreadings():
        seconds.setdefault(base_letter(letter), []).append(misread[1])
    return tuple(("[Ãã][" + "".join(re.escape(c) for c in chars) + "]", base) for base, chars in sorted(seconds.items()))


def fold(text: Column) -> Column:
    """Lower-case text without diacritics, with misread letters as what they stood for."""
    mended = text
    for pattern, letter in _misread_patterns():
        mended = F.regexp_replace(mended, pattern, letter)
    mended = F.regexp_replace(mended, "[âÂ](?:€.|[\u0080-¿])", " ")
    mended = F.when(text.rlike("[ÃãÂâ]"), mended).otherwise(text)
    bare = F.regexp_replace(mended, r"[\p{M}​-‍⁠﻿­]+", "")
    return F.translate(F.lower(bare), *folding_tables())


def words(text: Column) -> Column:
    """Folded runs of letters and digits, tags left out; an empty array for null."""
    no_tags = F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,80}>", " ")
    return F.filter(F.split(F.coalesce(fold(no_tags), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
