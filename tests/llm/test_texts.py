import random
import re

import numpy as np
import pytest

from beaconry.llm import boosting, byte_bpe, quality
from beaconry.llm.holdout import HOLDOUT, STAND_IN, TRIAL

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    loaded = tokenizers.Tokenizer.from_file(LIBRARY)
    loaded.encode_special_tokens = True
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n  x", "Hello world's it'll", "<|endoftext|> slut", "åäö ÅÄÖ 🚁🇸🇪 ë", "a" * 5000, "ab" * 3000 + "\t\t  x", "0123456789" * 200, "日本語 Ω ½", "​﻿\r\n \r", "!" * 999, " " * 777]


def test_ids_equal_the_library(library):
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY)
    pick = random.Random(4)
    made = ["".join(pick.choice("abcdefghij åö'1.\n{}") for _ in range(pick.randint(0, 400))) for _ in range(200)]
    for text in TEXTS + made:
        assert own.encode(text) == library(text), text[:60]


def test_long_pieces_stay_quick(library):
    pick = random.Random(6)
    text = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert byte_bpe.Encoder(byte_bpe.VOCABULARY).encode(text) == library(text)


def test_leftmost_minimum_of_the_tree():
    pick = random.Random(8)
    values = [pick.randint(0, 5) for _ in range(37)]
    tree = byte_bpe.MinTree(list(values))
    for _ in range(200):
        at, value = pick.randrange(37), pick.randint(0, 9)
        values[at] = value
        tree.update(at, value)
        assert tree.least() == (values.index(min(values)), min(values))


def test_null_and_empty_texts(spark, library):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "En text.", 0), (3, "En text.", 0)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in byte_bpe.token_ids(df).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, library("En text.")), (3, library("En text."))]
    assert byte_bpe.token_ids(df.limit(0)).count() == 0


def test_memory_of_pieces_is_only_a_shortcut(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY)
    assert [own.encode("en röd båt och en blå bil") for _ in range(3)] == [library("en röd båt och en blå bil")] * 3


def test_boosting_learns_a_rule():
    pick = np.random.default_rng(1)
    x = pick.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    assert ((model.margin(x[400:]) > 0) == (y[400:] > 0)).mean() > 0.93
    assert boosting.fit(x, np.zeros(600)).margin(x).max() < 0
    a, b = boosting.calibrate(model.margin(x[400:]), y[400:])
    assert a > 0 and abs(b) <= 4


def test_figures_of_odd_texts():
    for text in (None, "", " \n\t", "​", "-", "---", "a", "😀" * 300, "x" * 200_000, "|", ";;;;", "\x00\x01", "<td>", "Ã"):
        assert len(quality.figures(text)) == len(quality.FIGURES) and all(np.isfinite(quality.figures(text)))


def pieces_of(texts):
    """The texts, their lines and their sentences."""
    out = set()
    for text, _ in texts:
        out |= {x.strip().lower() for x in [text, *text.splitlines(), *re.split(r"[.!?]\s|\n", text)]}
    return {x for x in out if sum(c.isalpha() for c in x) >= 2 and set(x) - set("|- ")}


def test_no_text_is_in_two_sets():
    sets = {"stand-in": STAND_IN, "holdout": HOLDOUT, "trial": TRIAL}
    for a in sets:
        for b in sets:
            if a < b:
                assert not pieces_of(sets[a]) & pieces_of(sets[b])
                assert not [(x, y) for x, _ in sets[a] for y, _ in sets[b] if len(x) > 20 and x in y or len(y) > 20 and y in x]


def test_trial_texts_are_told_and_calibrated(spark):
    """Without a corpus to learn from, the stand-in texts must do."""
    rows = [(i, t, "clash") for i, (t, _) in enumerate(TRIAL)] + [(900, None, ""), (901, "", ""), (902, " \n", ""), (0, TRIAL[0][0], "")]
    got = [(r.doc_id, r.shape, r.probability) for r in quality.shapes(spark.createDataFrame(rows, "doc_id long, text string, shape string")).collect()]
    assert len(got) == len(TRIAL) + 1 and not {900, 901, 902} & {i for i, _, _ in got}
    wrong = [(TRIAL[i][1], s, TRIAL[i][0][:60]) for i, s, _ in got if TRIAL[i][1] != s]
    error = abs(sum(p for _, _, p in got) / len(got) - (1 - len(wrong) / len(got)))
    print("trial: wrong", len(wrong), "of", len(got), "calibration error", round(error, 3))
    assert len(wrong) <= 2 and error <= 0.15, (wrong, error)
    assert quality.shapes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
