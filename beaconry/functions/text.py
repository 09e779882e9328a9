"""String columns: word matching, keys, names, hashes, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .folding import misreadings

#: A boundary between ASCII word characters only; å, ä and ö count as boundaries.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
SWEDISH = "a-zåäö0-9"


def bounded(pattern: str) -> str:
    return f"{_BEFORE}(?:{pattern}){_AFTER}"


def edged(words: tuple[str, ...]) -> str:
    """A choice of words between ASCII word edges, as engines without Unicode see them: after å, ä or ö an edge needs a word character."""
    inside = "[A-Za-z0-9_]"

    def one(word: str) -> str:
        before = _BEFORE if re.match(inside, word[0]) else f"(?<={inside})"
        after = _AFTER if re.match(inside, word[-1]) else f"(?={inside})"
        return before + re.escape(word) + after

    return "|".join(map(one, words))


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_stem(column: str, stems: tuple[str, ...]) -> str:
    """SQL of the first of the stems, in their order, that a column contains; null if none.

    Long lists are written as SQL text, which is parsed in one step.
    """
    return "coalesce(" + ", ".join(f"if(contains({column}, {quoted(s)}), {quoted(s)}, null)" for s in stems) + ")"


def first_of(column: str, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first word that a column contains."""
    return F.expr("case " + " ".join(f"when contains({column}, {quoted(w)}) then {value}" for w, value in pairs) + " end")


def contains_any(column: str, words: tuple[str, ...]) -> str:
    """SQL of whether a column contains one of the words; plain searches beat one pattern with many branches."""
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def any_of(column: str, words: tuple[str, ...]) -> Column:
    """Whether a column contains one of the words."""
    return F.expr(contains_any(column, words))


def squeezed(text: Column) -> Column:
    """Without white space, in upper case: the comparable form of a plate."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def link_target(raw: Column) -> Column:
    """The target of a link, its alias left out."""
    return trimmed(F.split(raw, r"\|")[0])


def link_kind(raw: Column) -> Column:
    target = link_target(raw)
    return F.when(target.rlike(f"^{V.PLATE_LINK}$"), F.when(target.contains("."), "plate-partial").otherwise("plate-full")).otherwise("mark")


def plate_read(text: Column) -> Column:
    """A plate as read off a picture: no blanks or dashes, and no nation letter before a whole plate."""
    bare = F.upper(F.regexp_replace(text, r"[\s-]+", ""))
    return F.when((F.length(bare) == 7) & bare.rlike(f"^S{V.PLATE}$"), F.substring(bare, 2, 6)).otherwise(bare)


def same_plate(a: Column, b: Column) -> Column:
    bare = lambda c: F.translate(plate_read(c), "ÅÄÖ", "AAO")
    return bare(a) == bare(b)


def mark_key(label: Column) -> Column:
    """The order-free key of a mark's wording."""
    words = F.split(F.regexp_replace(F.lower(label), "[.,;:!?()\"']", " "), r"\s+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*V.KEY_STOP_WORDS))), " ")


def stem_of(file: Column) -> Column:
    """The name of a note, without folders and ending."""
    return F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.md$", "")


def safe_name(text: Column) -> Column:
    """A text as a file name."""
    return F.regexp_replace(text, r'[\\/:*?"<>|.\s#]', "_")


def short_hash(text: Column) -> Column:
    """The djb2 hash of the characters modulo 2**32, in base 36."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % 4294967296)
    return F.lower(F.conv(total.cast("string"), 10, 36))


def agent_name(display: Column, key: Column, most: int = 72) -> Column:
    """A readable file name without its ending; a long one is cut and told apart by the last signs of a hash of its key."""
    clean = trimmed(F.regexp_replace(F.regexp_replace(display, r'[\\/:*?"<>|#^\[\]]+', " "), r"\s+", " "))
    mark = F.substring(F.lpad(short_hash(key), 4, "0"), -4, 4)
    mark = F.when(F.length(short_hash(key)) > 4, F.substring(short_hash(key), -4, 4)).otherwise(mark)
    return F.when(F.length(clean) > most, F.concat(trimmed(F.substring(clean, 1, most)), F.lit("… ("), mark, F.lit(")"))).otherwise(clean)


def place_label(place: Column, nickname: Column) -> Column:
    """The operator's name of a place where there is one, else the place as written."""
    return F.coalesce(F.nullif(trimmed(nickname), F.lit("")), place)


def bare_grid(place: Column) -> Column:
    """Whether a place is a grid reference and nothing else."""
    return F.coalesce(F.regexp_replace(place, r"\s+", "").rlike(r"^\d{1,2}[C-X][A-Z][A-Z]\d+$"), F.lit(False))


def escaped(text: Column) -> Column:
    """Text that Markdown shows as it stands."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{Cntrl}", " "), r"([\\`*_\[\]<>|#~])", r"\\$1")


def repaired(text: Column) -> Column:
    """Letters that were decoded with the wrong encoding, put right; other text is untouched."""
    fixed = text
    for misread, letter in misreadings():
        if letter in "åäöÅÄÖéüøæß":
            fixed = F.replace(fixed, F.lit(misread), F.lit(letter))
    fixed = F.replace(F.replace(fixed, F.lit("Â "), F.lit(" ")), F.lit("Â"), F.lit(""))
    return F.when(text.contains("Ã") | text.contains("Â"), fixed).otherwise(text)


def level(score: Column) -> Column:
    """The band of a score, empty below the lowest."""
    out = F.lit("")
    for least, name in reversed(V.LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def reason_phrases(reasons: Column) -> Column:
    """Distinct phrases of an array of (key, label, weight), in its order."""
    known = F.create_map(*[F.lit(x) for pair in V.REASON_PHRASES.items() for x in pair])
    scrubbed = lambda c: trimmed(F.regexp_replace(F.regexp_replace(c, r"\s*\(\+\d+\)", ""), r"\s*\(~\d+\s*m\)", ""))
    phrase = lambda r: F.coalesce(
        F.try_element_at(known, r["key"]), F.when(r["key"].startswith("farkost:"), F.regexp_replace(r["label"], r"(?i)^farkost:\s*", "")), scrubbed(r["label"])
    )
    return F.array_distinct(F.filter(F.transform(reasons, phrase), lambda p: p != ""))


def minute_of_day(time: Column) -> Column:
    """Minutes since midnight of an ISO-like text; null when it has none."""
    hour = F.regexp_extract(time, r"T(\d{2}):(\d{2})", 1).try_cast("int")
    minute = F.regexp_extract(time, r"T(\d{2}):(\d{2})", 2).try_cast("int")
    return hour * 60 + minute


def hour_of(time: Column) -> Column:
    return F.regexp_extract(time, r"T(\d{2}):", 1).try_cast("int")


def in_window(minute: Column, start: int, end: int) -> Column:
    """Within a window of the day, both ends included; it may wrap around midnight."""
    return minute.between(start, end) if start <= end else (minute >= start) | (minute <= end)


def number_from_time(time: Column) -> Column:
    """DDHHMM of an ISO-like text; empty when it is none."""
    parts = r"^\d{4}-\d{2}-(\d{2})T(\d{2}):(\d{2})"
    return F.concat(*[F.regexp_extract(time, parts, i) for i in (1, 2, 3)])


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)
