"""Per-document statistics that tell prose from lists, tables and junk (problem 9).

Each document gets about thirty figures in one pass over its whole text: words,
symbols, lines, common words, repetition, and the shares of its characters that
lie in list items, rows of columns and noise. Boosted trees are trained on a
bounded sample of documents whose figures leave no doubt (the weak labels, four
classes), one tree model per class; their margins are calibrated on hand-written
texts of known shape that are never trained on (HOLDOUT of ``holdout.py``; TRIAL, a
further set, tests the result), and the most probable class is the document's shape.

The figures are computed once, without a shuffle, and written to the checkpoint
folder (about 0.3 KB a document). The sample is at most ``SAMPLE`` rows a class,
chosen by hash among all rows; nothing else goes to the driver.

Defined cases: null, empty and blank texts have figures of zero and no shape;
repeated rows each get theirs; a class that the weak labels leave without rows is
known from the texts of STAND_IN, which are always part of the sample; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import base_letter, misreadings
from ..session import ensure_checkpoint_dir, ship_package
from .boosting import Booster, calibrate, fit
from .holdout import HOLDOUT, STAND_IN

CLASSES = ("prose", "list", "table", "junk")
#: Most rows of a class that a model is trained on.
SAMPLE = 2_000

#: Frequent function words of the corpus' languages, folded (fixed values).
COMMON = frozenset(
    """och att det som en ett den de i pa av for med till fran vid om inte var har hade sa men nar ska eller efter under hur utan
    vi jag han hon man sig sin dar dess denna detta vara blev kan kom ha nu sedan mot ut upp ner igen samma nagon inget mer varav
    the of and to in a that is was for it with as his on be at by had not are but from or have an they which one were her all she
    there would their we him been has when who will no if out so said what up its about than into them can only other then could
    this over near asks might whether while just
    og er ikke av til fra ble vi ba ved hun han jeg etter noe hadde vaert der var sto mens ifolge
    der die das und ist nicht zu den mit von dem des im auf fur ein eine als auch es an sich aus bei nach wie wird war wurden dass
    ob aber einer einen einem oder zum zur vor durch uber
    ja on ei etta joka oli se han mutta kun ovat olla paikassa kertoo samaa sama aikana jalkeen lahella nahtiin ole varmaa pitkaan""".split()
)
#: Labels of page menus, folded (fixed values).
MENU = frozenset(
    """meny hem sok logga in ut dela avbryt stang x visa mer nasta foregaende skriv ok spara redigera tillbaka stanga kontakt
    menu home search log login logout sign share cancel close show more next previous print save edit back contact about help
    cookies accept subscribe read comments reply follow""".split()
)
_BULLET = re.compile(r"\s*(?:[-*+•◦▪·–—‣]|\[[ xX]?\]|[(]?\d{1,3}[.)]|[(]?[A-Za-zåäö][.)])\s+(?=\S)")
_LABEL = re.compile(r"\s*[*_]{0,2}[^\W\d_][\w \-/]{0,24}[*_]{0,2}:[*_]{0,2}(?:\s+|$)(.*)$")
_HEAD = re.compile(r"\s{0,3}#{1,6}\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{4,}\Z")
_PLATE = re.compile(r"[A-ZÅÄÖ]{2,3}\d{2,3}[A-Z]?[.,;:]?\Z|\d{2}[A-Z]{3}\d{6,10}[.,;:]?\Z|\d{1,2}:\d{2}[.,;:]?\Z")
_SENTENCE_END = re.compile(r"[.!?…][\"'»)]?(?:\s|$)")
_TAGS = re.compile(r"(?i)</?(?:table|thead|tbody)[^>]*>")
_ROW_END = re.compile(r"(?i)</tr>|<br\s*/?>")
_CELL_END = re.compile(r"(?i)</t[dh]>\s*<t[dh][^>]*>")
_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_CELLS = re.compile(r"[ \xa0]{2,}|\t+")
_MISREAD = dict(misreadings())
_MISREAD_ANY = re.compile("|".join(sorted(map(re.escape, _MISREAD), key=len, reverse=True)))
_SPLIT = re.compile(r"(?<=[.!?…])\s+")
_RULE = set("-=_*#|:+ \t")
_ODD = str.maketrans("", "", "ÃÂâïÑÐœŒƒ€¢¤¥¶½¿£^~\\{}<>|=$#@")
_VOWEL = re.compile("[aeiouyåäöæøüAEIOUYÅÄÖÆØÜ]")

FIGURES = (
    "chars words mean_word long_word lines mean_line short_lines ended_lines symbol_share digit_share upper_share common_share known_lines list_share bullet_share "
    "label_share enum_share table_share meta_share rest_share noise_share token_noise menu_share line_repeat word_repeat gram_repeat zip_ratio sentence_share vowel_odd odd_share"
).split()


_FOLDED = str.maketrans({c: base_letter(c) for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(base_letter(c)) == 1} | {chr(c): None for c in range(0x300, 0x370)})


def _fold(text: str) -> str:
    return text.lower().translate(_FOLDED)


def _solid(text: str) -> int:
    """Characters that are not white space."""
    return sum(map(len, text.split()))


def _cells(line: str) -> tuple[str, int, float]:
    """Kind of separator, number of cells, and words a cell, of a line that may be a row."""
    best = ("", 1, 99.0)
    for kind in "|", "\t", ";", "  ":
        if kind == "  ":
            cells = [c for c in _CELLS.split(line.strip()) if c] if "  " in line or "\xa0\xa0" in line or "\xa0 " in line else [line]
        else:
            cells = line.strip().strip("|").split(kind) if kind == "|" else line.strip().split(kind)
        if len(cells) > best[1]:
            best = (kind, len(cells), len(line.split()) / len(cells))
    return best


def _row_lines(lines: list[str]) -> list[bool]:
    """Lines of blocks of two or more rows with equally many cells."""
    shape = [_cells(x) for x in lines]
    is_row = [False] * len(lines)
    for i in range(len(lines) - 1):
        (kind, n, words), (kind2, n2, words2) = shape[i], shape[i + 1]
        least = 3 if kind in ";  " else 2
        if kind and kind == kind2 and n == n2 and n >= least and words <= 4 and words2 <= 4 and n <= 40:
            is_row[i] = is_row[i + 1] = True
    return is_row


def _listed(line: str) -> bool:
    """A bare enumeration: many short items without a sentence among them."""
    if sum(map(str.isalnum, line)) < 0.6 * _solid(line):
        return False
    for mark in ",", ";", " / ", " | ", " · ":
        items = line.split(mark)
        if len(items) >= 4:
            words = [len(x.split()) for x in items]
            if sum(words) / len(items) <= 3.6 and max(words) <= 8 and len(_SENTENCE_END.findall(line)) <= 1:
                return True
    return False


def _noisy(token: str) -> bool:
    """A token that is no word, number, plate or grid of any language."""
    bare = token.strip(".,;:!?\"'()[]«»*_…")
    if not bare:
        return len(token) > 2
    if _PLATE.match(token) or bare.isdigit():
        return False
    letters = sum(c.isalpha() for c in bare)
    if letters == 0:
        return len(bare) > 1 and not any(c.isdigit() for c in bare)
    if _HEX.match(bare) and any(c.isdigit() for c in bare):
        return True
    if len(bare) > 32:
        return True
    if letters < 0.6 * len(bare):
        return True
    if len(bare) >= 3 and letters == len(bare) and bare.isascii() and not _VOWEL.search(bare) and not bare.isupper():
        return True
    # changing case or digits in the middle of a longer token
    turns = sum(a.islower() and (b.isupper() or b.isdigit()) or a.isdigit() and b.isalpha() for a, b in zip(bare, bare[1:]))
    return turns >= 2 and "-" not in bare


@functools.lru_cache(200_000)
def _token(token: str) -> tuple[bool, tuple[str, ...], int]:
    """Whether a token is noise, its folded words if not, and how many of them are common."""
    if _noisy(token):
        return True, (), 0
    found = tuple(_WORD.findall(_fold(token)))
    return False, found, sum(w in COMMON for w in found)


def _kind(line: str, stripped: str, is_row: bool) -> str:
    """Which share a line's characters count in."""
    if is_row:
        return "table"
    if _HEAD.match(line) or set(stripped) <= _RULE:
        return "table" if "|" in stripped else "meta"
    mark = _BULLET.match(line)
    if mark and _short(line[mark.end() :], 8):
        return "bullet"
    named = _LABEL.match(line)
    if named and _short(named[1], 6):
        return "label"
    return "enum" if _listed(line) else "rest"


def _short(content: str, most: int) -> bool:
    words = len(content.split())
    return words <= most and not (words >= 5 and _SENTENCE_END.search(content))


def _sentences(line: str) -> int:
    """Characters of a line in sentences: five or more words with common ones among them."""
    size = 0
    for part in _SPLIT.split(line):
        tokens = part.split()
        seen = [_token(t) for t in tokens]
        n = sum(len(w) for _, w, _ in seen)
        if n >= 5 and sum(c for _, _, c in seen) >= 0.12 * n and sum(x[0] for x in seen) <= 0.3 * len(seen):
            size += sum(map(len, tokens))
    return size


def figures(text: str | None) -> list[float]:
    """The statistics of one text, in the order of FIGURES."""
    if not text or not text.strip():
        return [0.0] * len(FIGURES)
    text = _MISREAD_ANY.sub(lambda m: _MISREAD[m[0]], text) if "Ã" in text else text
    shown = text
    if "<" in text:
        shown = _ANY_TAG.sub(" ", _CELL_END.sub("\t", _ROW_END.sub("\n", _TAGS.sub("\n", text))))
    lines = [x for x in shown.splitlines() if x.strip()] or ["-"]
    rows = _row_lines(lines)
    shares = Counter()
    words: list[str] = []
    common = noise_all = n_tokens = longest = known = menu = sentence = rest_words = rest_common = 0
    in_head = lines[0].strip() == "---"
    for k, line in enumerate(lines):
        tokens = line.split()
        size = sum(map(len, tokens))
        seen = [_token(t) for t in tokens]
        found = [w for _, ws, _ in seen for w in ws]
        line_common = sum(c for _, _, c in seen)
        words += found
        common += line_common
        known += line_common > 0
        n_tokens += len(tokens)
        noise_all += sum(x[0] for x in seen)
        longest = max(longest, max(map(len, tokens)))
        menu += size <= 30 and bool(found) and all(w in MENU for w in found)
        if in_head and k < 15:
            in_head = not (k and line.strip() == "---")
            kind = "meta"
        else:
            kind = _kind(line, line.strip(), rows[k])
        shares[kind] += size
        if kind == "rest":
            shares["noise"] += sum(len(t) for t, x in zip(tokens, seen) if x[0])
            sentence += _sentences(line)
            rest_words += len(found)
            rest_common += line_common
    flat = "".join(shown.split())
    total = solid = max(1, len(flat))
    alpha, digits, upper = sum(map(str.isalpha, flat)), sum(map(str.isdigit, flat)), sum(map(str.isupper, flat))
    odd = len(flat) - len(flat.translate(_ODD)) if rest_common < 0.05 * max(1, rest_words) or not rest_words else 0
    grams = list(zip(words, words[1:], words[2:]))
    letters = sum(map(len, words)) or 1
    vowels = len(_VOWEL.findall("".join(words)))
    raw = text.encode("utf-8", "replace")
    listed = shares["bullet"] + shares["label"] + shares["enum"]
    return [
        math.log1p(total),
        math.log1p(len(words)),
        letters / max(1, len(words)),
        math.log1p(longest),
        math.log1p(len(lines)),
        math.log1p(total / len(lines)),
        sum(len(x) <= 40 for x in lines) / len(lines),
        sum(x.rstrip()[-1] in ".!?…:»\"" for x in lines) / len(lines),
        (solid - alpha - digits) / solid,
        digits / solid,
        upper / max(1, alpha),
        common / max(1, len(words)),
        known / len(lines),
        listed / total,
        shares["bullet"] / total,
        shares["label"] / total,
        shares["enum"] / total,
        shares["table"] / total,
        shares["meta"] / total,
        shares["rest"] / total,
        shares["noise"] / total,
        noise_all / max(1, n_tokens),
        menu / len(lines),
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / max(1, len(words)),
        1 - len(set(grams)) / max(1, len(grams)) if grams else 0.0,
        len(zlib.compress(raw, 1)) / (len(raw) + 12),
        sentence / total,
        abs(vowels / letters - 0.38),
        odd / solid,
    ]


def weak_label(figure) -> "F.Column":
    """The class that a document's figures leave no doubt about, else null; ``figure`` gives a figure's column."""
    f = figure
    structured = f("list_share") + f("table_share")
    body = f("list_share") + f("table_share") + f("rest_share")
    prose = (f("sentence_share") >= 0.65 * body) & (structured <= 0.25 * body) & (f("common_share") >= 0.15) & (f("gram_repeat") < 0.5)
    listed = (f("list_share") >= 0.75) & (f("table_share") < 0.1) & (f("common_share") < 0.2) & (f("menu_share") < 0.3) & (f("gram_repeat") < 0.6)
    rows = (f("table_share") >= 0.75) & (f("list_share") < 0.1)
    junk = (
        ((f("noise_share") >= 0.6) & (f("common_share") < 0.05))
        | (f("menu_share") >= 0.8)
        | ((f("gram_repeat") >= 0.8) & (f("words") > math.log1p(12)) & (f("table_share") < 0.2))
        | ((f("rest_share") >= 0.9) & (f("common_share") < 0.02) & (f("words") > math.log1p(8)) & (f("sentence_share") < 0.02))
    )
    return F.when(junk, "junk").when(prose, "prose").when(listed, "list").when(rows, "table")


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, *FIGURES) of every document."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("array<float>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([figures(x) for x in batch], dtype=object)

    # Of a null or blank text the first figure is 0.
    return documents.select(key, measured(F.col(text)).alias("f"))


def _figure(name: str):
    return F.get("f", F.lit(FIGURES.index(name)))


def _train(measured: DataFrame, key: str) -> list[tuple[Booster, float, float]]:
    labelled = measured.filter(F.get("f", F.lit(0)) > 0).withColumn("weak", weak_label(_figure)).filter(F.col("weak").isNotNull())
    order = F.xxhash64(F.col(key).cast("string"))
    parts = [labelled.filter(F.col("weak") == c).orderBy(order, key).limit(SAMPLE).select("f", "weak") for c in CLASSES]
    rows = [r for part in parts for r in part.collect()]  # at most SAMPLE a class
    x = [list(r["f"]) for r in rows] + [figures(t) for t, _ in STAND_IN]
    y = [r["weak"] for r in rows] + [c for _, c in STAND_IN]
    x, y = np.array(x, float), np.array(y)
    held, truth = np.array([figures(t) for t, _ in HOLDOUT], float), np.array([c for _, c in HOLDOUT])
    models = []
    for c in CLASSES:
        model = fit(x, (y == c).astype(float))
        slope, offset = calibrate(model.margin(held), (truth == c).astype(float))
        models.append((model, slope, offset))
    return models


def probabilities(models: list[tuple[Booster, float, float]], x: np.ndarray) -> np.ndarray:
    """Calibrated probability of each class, scaled to sum 1."""
    p = np.stack([1 / (1 + np.exp(-np.clip(a * m.margin(x) + b, -30, 30))) for m, a, b in models], axis=1)
    return p / p.sum(axis=1, keepdims=True)


def shapes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shape, probability) of every document that has a text."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    measured = statistics(documents, key, text).checkpoint()
    models = spark.sparkContext.broadcast(_train(measured, key))

    @F.pandas_udf("struct<shape:string,probability:double>")
    def classed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_list()).astype(float) if len(batch) else np.zeros((0, len(FIGURES)))
            p = probabilities(models.value, x) if len(x) else np.zeros((0, len(CLASSES)))
            yield pd.DataFrame({"shape": np.array(CLASSES)[p.argmax(1)] if len(p) else [], "probability": p.max(1) if len(p) else []})

    return measured.filter(F.get("f", F.lit(0)) > 0).select(key, classed("f").alias("c")).select(key, "c.shape", "c.probability")
