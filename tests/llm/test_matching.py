import os
import random
import re

import pytest

from pyspark.sql import functions as F

from beaconry.llm import canonical, components, cooccurrence, leakage
from beaconry.session import ensure_checkpoint_dir, stored

CATALOGUE = "ref_id int, label string, object string, aliases array<string>, colour string, detail string, phrase string"
LISTED = [
    (1, "x", "ryggsäck", ["rygga"], "röd", "röda skosnören", "clash"), (2, "x", "ryggsäck", ["rygga"], "blå", "gult snöre", "clash"), (3, "x", "kamerastativ", ["trefot"], "röd", "tryckt trefot", "clash"),
    (4, "x", "gummibåt", ["uppblåsbar båt"], "mörkblå", "lapp med tre ränder", "clash"), (5, "x", "ryggsäck", None, "grå", "gult snöre", "clash"),
]


def assigned(spark, marks, reports=()):
    m = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(marks)], "mark_id long, file string, label string, key string, whole int")
    r = spark.createDataFrame([(*x, "clash") for x in reports], "file string, symbol string, label string")
    return {x.mark_id: x.ref_id for x in canonical.assign(m, r, spark.createDataFrame(LISTED, CATALOGUE)).collect()}


def test_ways_to_write_an_entry(spark):
    same = ["röd ryggsäck med röda skosnören", "RÖDA SKOSNÖREN PÅ RÖD RYGGA", "rod ryggsack, röda skosnoren", "rÃ¶d ryggsÃ¤ck (rÃ¶da skosnÃ¶ren)", "troligen rödfärgad rygsäcken med röda skosnröen?", "samma röda ryggsäcken - röda skosnören"]
    got = assigned(spark, [("f", s, None) for s in same])
    assert set(got.values()) == {1} and len(got) == len(same)


def test_each_part_must_agree(spark):
    marks = ["röd trefot med tryckt trefot", "tryckt trefot på röd trefot", "röd kamerastativ", "blå ryggsäck med röda skosnören", "grå ryggsäck med gult snöre", "blå ryggsäck m gult snöre", "mörk-blå uppblåsbar båt med lapp med tre ränder",
             "marinblå gummibåt (lapp med tre ränder)", "blå gummibåt med lapp med tre ränder", "barnvagn", "", None, "   "]
    got = assigned(spark, [("f", s, None) for s in marks])
    assert [got[i] for i in range(len(marks))] == [3, 3, -1, -1, 5, 2, 4, 4, -1, -1, -1, -1, -1]


def test_key_and_report_stand_in(spark):
    symbol = "röd ryggsäck med röda skosnören; blå ryggsäck. grå ryggsäck med gult snöre"
    marks = [("f", "röd ryg", None), ("f", "blå ryggsäck", "blå ryggsäck"), ("f", None, "gult grå ryggsäck snöre"), ("g", "röd ryggs", None), (None, "röd ryggs", None), ("f", "röd ryg", None), ("h", None, None)]
    got = assigned(spark, marks, [("f", symbol), ("h", "grå ryggsäck med gult snöre")])
    assert [got[i] for i in range(7)] == [1, -1, 5, -1, -1, 1, 5]


def test_pigeonhole_finds_all_near_words(spark):
    pick = random.Random(2)
    known = ["ryggsack", "kamerastativ", "keps", "gul", "transportbil"]
    typed = {w for w in known}
    for w in known * 12:
        x = list(w)
        for _ in range(pick.randint(1, 3)):
            at = pick.randrange(len(x))
            pick.choice([lambda: x.__setitem__(at, "e"), lambda: x.insert(at, "o"), lambda: x.pop(at) if len(x) > 2 else None])()
        typed.add("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    most = lambda w: 1 if len(w) < 5 else 2 if len(w) < 7 else 3
    want = set()
    for t in typed:
        near = [(distance(t, w), w) for w in known if distance(t, w) <= most(w) and len(t) >= 2]
        want |= {(t, w, d) for d, w in near if d == min(near)[0]}
    got = canonical.nearest(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in known], "word string")).collect()
    assert {(r.typed, r.word, r.edits) for r in got} == want


def test_empty_tables(spark):
    assert assigned(spark, []) == {}
    m = spark.createDataFrame([(1, "f", "röd ryggsäck", None)], "mark_id long, file string, label string, key string")
    r = spark.createDataFrame([], "file string, symbol string")
    assert [x.ref_id for x in canonical.assign(m, r, spark.createDataFrame([], CATALOGUE)).collect()] == [-1]


def pairs_by_hand(baskets, least, lift):
    items = {}
    for b, x in baskets:
        items.setdefault(x, set()).add(b)
    n = len({b for b, _ in baskets})
    return {(a, b) for a in items for b in items if a < b and len(items[a] & items[b]) >= least and len(items[a] & items[b]) * n >= lift * len(items[a]) * len(items[b])}


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_pairs_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
    monkeypatch.setattr(cooccurrence, "BLOCK_OCCURRENCES", 300)
    monkeypatch.setattr(cooccurrence, "BASKET_IN_BLOCK", 1 if chunk == 7 else 10_000)
    pick = random.Random(3)
    baskets = {(f"b{i}", f"x{pick.randint(0, 40)}") for i in range(300) for _ in range(pick.randint(0, 6))} | {(f"b{i}", x) for i in range(12) for x in ("x1", "x2", "x3")} | {(f"b{i}", "hub") for i in range(280)}
    df = spark.createDataFrame(sorted(baskets), "record string, item string")
    for least, lift in ((5, 5), (2, 1)):
        got = cooccurrence.together(df, least, lift).collect()
        assert {(r.item_a, r.item_b) for r in got} == pairs_by_hand(baskets, least, lift) and len(got) == len({(r.item_a, r.item_b) for r in got})


def test_occurrences_ignore_nulls_and_repeats(spark):
    facets = spark.createDataFrame([("a", ["m1", "m1", None], "z"), ("a", ["m1"], "z"), ("b", None, "z"), ("b", [], "z"), (None, ["m1"], "z")], "facet_id string, files array<string>, item string")
    steps = spark.createDataFrame([("m1", ["a", "b", None], 1), (None, ["a"], 1), ("m2", None, 1)], "file string, facets array<string>, n int")
    assert sorted((r.record, r.item) for r in cooccurrence.occurrences(facets, steps).collect()) == [("m1", "a"), ("m1", "b")]
    assert cooccurrence.together(cooccurrence.occurrences(facets.limit(0), steps.limit(0))).count() == 0


def test_groups_of_chains_rings_and_stars(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(80)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r1", "r2")]
    rows = [(a, b, 2, "x") for a, b in chain + star + ring] + [("c000", "hub", 1, "x"), ("z", "z", 9, "x"), ("y", None, 9, "x"), ("q", "w", None, "x"), ("q", "w", 0, "x"), ("r3", "r1", -1, "x")]
    random.Random(1).shuffle(rows)
    got = components.components(components.links(spark.createDataFrame(rows, "a string, b string, weight int, u string"))).collect()
    assert len(got) == 61 + 81 + 3 and {r.node: r.root for r in got} == {f"c{i:03}": "c000" for i in range(61)} | {x: "hub" for x in ["hub"] + [f"s{i:03}" for i in range(80)]} | {x: "r1" for x in ("r1", "r2", "r3")}
    assert components.components(components.links(spark.createDataFrame([], "a string, b string, weight int"))).count() == 0


def test_leaks_of_thirteen_words(spark):
    words = [f"ord{i}" for i in range(40)]
    item = " ".join(words)
    docs = [
        (1, "före " + " ".join(words[5:18]) + " efter"), (2, "före " + " ".join(words[5:17]) + " efter"), (3, "**" + "**, _".join(w.upper() for w in words[20:33]) + "_!"), (4, None), (5, ""), (6, " ".join(words[27:])),
        (7, " ".join(words[:6] + ["annat"] + words[6:18])), (8, "<p>" + "\n".join(words[:13]) + "</p>"), (9, "\n".join(words[:13] * 3)),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "för kort text", 0), (3, None, 0), (None, item, 0), (4, " ".join(words[5:18]), 0)], "item_id int, text string, token int")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, items).collect())
    assert got == [(1, 1), (1, 4), (3, 1), (6, 1), (8, 1), (9, 1)]
    assert leakage.leaks(d.limit(0), items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0


def test_damaged_letters_do_not_hide_a_leak(spark):
    item = "på väg till sjön såg vi en röd båt över där under åsen när det blåste hårt"
    docs = [(1, "på väg till sjön såg vi en röd båt över där under åsen".encode().decode("cp1252")), (2, "PA VAG TILL SJON SAG VI EN ROD BAT OVER DAR UNDER ASEN"), (3, "på väg till sjön såg vi en röd båt över där under åsen")]
    docs[2] = (3, docs[2][1][:1] + docs[2][1][1:].replace("å v", "å v", 1))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]


def test_a_long_reference_list_is_joined_by_shuffles(spark, monkeypatch):
    symbol = "röd ryggsäck med röda skosnören; blå ryggsäck. grå ryggsäck med gult snöre"
    marks = [("f", "röd ryg", None), ("f", None, "gult grå ryggsäck snöre"), ("g", "blå rygga, gult snöre", None), ("g", "barnvagn", None), ("g", "tryckt trefot på röd trefot", None)]
    few = assigned(spark, marks, [("f", symbol)])
    monkeypatch.setattr(canonical, "BROADCAST_ENTRIES", 0)
    assert assigned(spark, marks, [("f", symbol)]) == few == {0: 1, 1: 5, 2: 2, 3: -1, 4: 3}


def test_terms_of_short_words_only(spark):
    listed = spark.createDataFrame([(1, "x", "keps", None, "röd", "av en ko", ""), (2, "x", "keps", None, "röd", "ny ko", ""), (3, "x", "keps", None, "blå", "å", "")], CATALOGUE)
    m = spark.createDataFrame([(i, "f", t, None) for i, t in enumerate(["röd keps med av en ko", "röd keps, ny ko", "blå keps å", "röd keps"])], "mark_id long, file string, label string, key string")
    got = {x.mark_id: x.ref_id for x in canonical.assign(m, spark.createDataFrame([], "file string, symbol string"), listed).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: -1}


def test_marks_without_words_take_what_no_other_was_taken_from(spark):
    symbol = "röd ryggsäck med röda skosnören; blå ryggsäck med gult snöre"
    got = assigned(spark, [("f", None, None), ("f", "blå ryggsäck med gult", None), ("g", "", None), ("h", None, None)], [("f", symbol), ("g", symbol), ("h", symbol + "; " + symbol)])
    # In g and h two parts are as likely as each other, and they mean different entries.
    assert got == {0: 1, 1: 2, 2: -1, 3: -1}
    repeated = assigned(spark, [("f", None, None)], [("f", "röd ryggsäck med röda skosnören; RÖD ryggsäck (röda skosnören)")])
    assert repeated == {0: 1}


def test_hashes_that_meet_take_another_seed(spark, monkeypatch):
    real = cooccurrence._code
    monkeypatch.setattr(cooccurrence, "_code", lambda column, seed: F.lit(1).cast("long") if seed == 0 else real(column, seed))
    baskets = {(f"b{i}", x) for i in range(6) for x in ("x", "y")} | {(f"c{i}", f"z{i}") for i in range(60)}
    got = cooccurrence.together(spark.createDataFrame(sorted(baskets), "record string, item string")).collect()
    assert [(r.item_a, r.item_b, r.n) for r in got] == [("x", "y", 6)]


def test_only_large_records_get_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BASKET_IN_BLOCK", 10)
    blocks = []
    real = cooccurrence.products
    monkeypatch.setattr(cooccurrence, "products", lambda df, r, i: blocks.append((df.select("record").distinct().count(), i)) or real(df, r, i))
    rows = [(1, x) for x in range(200)] + [(r, x) for r in range(2, 30) for x in range(3)]
    got = {(r.a, r.b): r.n for r in cooccurrence.gram(spark.createDataFrame(rows, "record long, item long")).collect()}
    assert blocks == [(28, 4), (1, 20)] and len(got) == 200 * 199 // 2 and got[(0, 1)] == 29 and got[(5, 9)] == 1


def with_settings(spark, settings, run):
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return run()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_a_hot_node_is_split(spark):
    pairs = spark.range(60_000).select(F.concat(F.lit("n"), F.col("id")).alias("u"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("m"), F.col("id"))).alias("v"))
    tiny = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def plan():
        around = stored(components._both(pairs))
        star = components.rewired(around, stored(components.minima(around)))
        star.collect()
        return star._jdf.queryExecution().executedPlan().toString()

    assert "skew=true" in with_settings(spark, tiny, plan)


def test_tables_of_earlier_rounds_are_removed(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    components.components(components.links(spark.createDataFrame([(f"a{i}", f"a{i + 1}", 2) for i in range(20)], "a string, b string, weight int"))).count()
    assert len(set(os.listdir(folder)) - before) == 1


@pytest.mark.parametrize("words_in_row", [0, 20_000])
def test_leaks_in_blocks_and_pieces(spark, monkeypatch, words_in_row):
    monkeypatch.setattr(leakage, "IN_ROW_WORDS", words_in_row)
    monkeypatch.setattr(leakage, "BROADCAST_RUNS", 3)
    monkeypatch.setattr(leakage, "PIECE", 5)
    pick = random.Random(7)
    items = [(i, " ".join(pick.choice("abcdefgh") * pick.randint(1, 2) for _ in range(30))) for i in range(4)]
    docs = [(i, " ".join(pick.choice("abcdefghx") for _ in range(pick.randint(0, 60)))) for i in range(40)]
    for i in range(20):
        words = items[i % 4][1].split()
        at = pick.randint(0, 18)
        docs.append((100 + i, docs[i][1] + " " + " ".join(words[at : at + pick.randint(11, 15)]) + " slut"))
    runs = {i: {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for i, w in ((i, t.split()) for i, t in items)}
    want = sorted((d, i) for d, t in docs for i in runs if runs[i] & {tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)})
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert want and sorted((r.doc_id, r.item_id) for r in found.collect()) == want
    # Neither texts nor their words are shuffled, only windows that match.
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert shuffled and not any(re.search(r"\b(w|text)#", x) for x in shuffled)
