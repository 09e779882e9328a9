"""Free-entered marks mapped to a reference list (problem 2).

Reference strings (objects with their other names, colours, details, in the forms
they are written in) are cut into k+1 segments each. A typed word within k edits
must hold one of them, nearly in its place, so typed words are joined with the
reference by equality of segments and then verified with levenshtein(). Words
make up the terms of a phrase; a phrase's object, colour and detail name at most
one entry, and what has none is reported through an anti-join.

Each distinct word is compared once. Of a mark's label, its key and the part of its
report's text it was taken from, the first that names all three parts answers. The
part is the one that shares most with label and key; where several do alike (nothing
is left of either), it must be one that no other mark of the report was surely taken
from, and all that remain must mean the same.

A reference list of any length works: up to ``BROADCAST_ENTRIES`` entries its forms are
broadcast, beyond that they are joined by shuffles. Word meanings and answers are
written as tables, so nothing is evaluated twice and a frequent word is split.

Defined cases: null, blank, cut-off and vague values without a full source, and
values that name no entry or two equally near ones, give -1; a mark extracted
twice gives two rows; marks without a report keep what label and key say; an
empty reference list leaves every mark unmatched; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..session import stored

#: Words that mean nothing for the entry: hedges, articles, joining words (fixed values).
IDLE = "en ett den det med m me pa i och typ ev samma troligen nan nagon sorts slags".split()
#: Other names of colours (fixed values).
COLOUR_NAMES = {
    "violett": "lila", "brandgul": "orange", "marinbla": "morkbla", "askgra": "gra", "sandfargad": "beige", "kolsvart": "svart",
}
#: Endings that inflected colours and definite objects may have.
COLOUR_ENDINGS = ["", "a", "t", "fargad", "fargat", "aktig"]
OBJECT_ENDINGS = ["", "n", "en", "et", "t", "na", "arna"]
#: Edits allowed to words of 3 letters and more, below 5 letters, below 7, and longer ones.
EDITS_SHORT, EDITS_MIDDLE, EDITS = 1, 2, 3
UNMATCHED = -1
#: Entries of the reference list that may be broadcast, with some 2 KB of forms each.
BROADCAST_ENTRIES = 20_000


def content(text: Column) -> Column:
    """Folded words that carry meaning; a shade written apart (mörk-blå) is one word."""
    joined = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\b(mork|ljus)[\s-]+(?=\p{L})", "$1")
    return F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(IDLE))


def plain(text: Column) -> Column:
    """The content of a text as one string."""
    return F.array_join(content(text), " ")


def tidied(catalogue: DataFrame) -> DataFrame:
    """The reference list with its parts as content: (ref_id, object, colour, detail, names)."""
    names = F.concat(F.array("object"), F.coalesce("aliases", F.array().cast("array<string>")))
    return catalogue.select(
        "ref_id", plain(F.col("object")).alias("object"), plain(F.col("colour")).alias("colour"), plain(F.col("detail")).alias("detail"), F.transform(names, plain).alias("names")
    )


def terms(catalogue: DataFrame) -> DataFrame:
    """(part, value, term, i, n, word): word i of the n words of a way to write a value; part is o, c or d."""
    tidy = tidied(catalogue).select("object", "colour", "detail", "names")
    objects = tidy.select(F.lit("o").alias("part"), F.col("object").alias("value"), F.explode("names").alias("term"))
    colours = tidy.select(F.lit("c").alias("part"), F.col("colour").alias("value"), F.col("colour").alias("term"))
    details = tidy.select(F.lit("d").alias("part"), F.col("detail").alias("value"), F.col("detail").alias("term"))
    table = F.create_map(*[F.lit(x) for pair in COLOUR_NAMES.items() for x in pair])
    others = catalogue.sparkSession.range(1).select(F.explode(table).alias("term", "value")).select(F.lit("c").alias("part"), "value", "term")
    every = objects.unionByName(colours).unionByName(others).unionByName(details).filter((F.col("term") != "") & (F.col("value") != "")).distinct()
    # Short words of a term need not be written, unless it has no others.
    spoken = F.split("term", " ")
    longer = F.filter(spoken, lambda w: F.length(w) > 3)
    listed = F.when(F.size(longer) > 0, longer).otherwise(spoken)
    return every.select("part", "value", "term", F.posexplode(listed).alias("i", "base"), F.size(listed).alias("n")).select(
        "part", "value", "term", "i", "n", F.explode(_forms()).alias("word")
    ).distinct()


def _forms() -> Column:
    word, part = F.col("base"), F.col("part")
    ending = lambda list_: F.array(*[F.concat(word, F.lit(e)) for e in list_])
    # Words in -el and -er lose the vowel before an ending.
    bent = F.array(*[F.concat(F.expr("substring(base, 1, length(base) - 2)"), F.substring(word, -1, 1), F.lit(e)) for e in ("et", "en", "a")])
    objects = F.when(word.rlike("e[lr]$"), F.concat(ending(OBJECT_ENDINGS), bent)).otherwise(ending(OBJECT_ENDINGS))
    return F.when(part == "o", objects).when(part == "c", ending(COLOUR_ENDINGS)).otherwise(F.array(word))


def _edits(length: Column) -> Column:
    return F.when(length < 3, F.lit(0)).when(length < 5, F.lit(EDITS_SHORT)).when(length < 7, F.lit(EDITS_MIDDLE)).otherwise(F.lit(EDITS))


def _place(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of k+1; the longer ones come last."""
    base, longer = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    late = i - (k + 1 - longer)
    return i * base + F.greatest(late, F.lit(0)), base + F.when(late >= 0, 1).otherwise(0)


def reference_segments(reference: DataFrame) -> DataFrame:
    """(word, length, i, segment) of the distinct reference words."""
    cut = reference.select("word", F.length("word").alias("length")).filter("length >= 1").distinct().withColumn("k", _edits(F.col("length")))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start, size = _place(F.col("length"), F.col("k"), F.col("i"))
    return cut.select("word", "length", "i", F.substring(F.col("word"), start + 1, size).alias("segment"))


def typed_segments(typed: DataFrame) -> DataFrame:
    """(typed, length, i, segment): the substrings of a word that could equal a segment of a reference word of ``length``."""
    own = F.length("typed")
    tried = (
        typed.filter(own >= 1)
        .withColumn("length", F.explode(F.sequence(F.greatest(own - EDITS, F.lit(1)), own + EDITS)))
        .withColumn("k", _edits(F.col("length")))
        .filter(F.abs(own - F.col("length")) <= F.col("k"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    )
    start, size = _place(F.col("length"), F.col("k"), F.col("i"))
    drift = own - F.col("length")
    low = F.greatest(start - F.col("i"), start + drift - (F.col("k") - F.col("i")), F.lit(0))
    high = F.least(start + F.col("i"), start + drift + (F.col("k") - F.col("i")), own - size)
    placed = tried.withColumns({"low": low, "high": high, "size": size}).filter("low <= high")
    return placed.withColumn("at", F.explode(F.sequence("low", "high"))).select(
        "typed", "length", "i", F.substring(F.col("typed"), F.col("at") + 1, F.col("size")).alias("segment")
    ).distinct()


def nearest(typed: DataFrame, reference: DataFrame, few: bool = True) -> DataFrame:
    """(typed, word, edits): the nearest reference words within k edits of each distinct typed word; ``few`` reference words are broadcast."""
    cut = reference_segments(reference)
    pairs = typed_segments(typed.distinct()).join(F.broadcast(cut) if few else stored(cut), ["length", "i", "segment"]).select("typed", "word").distinct()
    far = F.levenshtein("typed", "word")
    close = pairs.withColumn("edits", far).filter(F.col("edits") <= _edits(F.length("word")))
    best = Window.partitionBy("typed")
    return close.withColumn("least", F.min("edits").over(best)).filter("edits = least").drop("least")


def read_phrases(phrases: DataFrame, reference: DataFrame, catalogue: DataFrame, few: bool = True) -> DataFrame:
    """(phrase, whole, ref_id) of phrases of content words: whether one names all three parts, and its entry or null."""
    small = F.broadcast if few else (lambda df: df)
    listed = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "typed"))
    near = nearest(listed.select("typed"), reference, few)
    # A frequent word is met in very many phrases; its meaning is read from a table, so that adaptive execution splits it.
    meant = stored(near.join(small(reference), "word").groupBy("typed").agg(F.collect_set(F.struct("part", "value", "term", "i", "n", "edits")).alias("meant")))
    hits = listed.join(meant, "typed").select("phrase", "at", F.inline("meant"))
    worded = hits.groupBy("phrase", "part", "value", "term", "n", "i").agg(F.collect_set("at").alias("at"), F.min("edits").alias("edits"))
    named = (
        worded.groupBy("phrase", "part", "value", "term", "n")
        .agg(F.count(F.lit(1)).alias("seen"), F.flatten(F.collect_list("at")).alias("at"), F.sum("edits").alias("edits"))
        .filter("seen = n")
        .groupBy("phrase")
        .agg(F.collect_list(F.struct("part", (-F.col("n")).alias("m"), "edits", "value", "at")).alias("found"))
    )
    only = lambda part: F.filter("found", lambda x: x["part"] == part)
    # The detail with most words, then fewest edits, keeps its words to itself; a word met twice stays free.
    named = named.withColumn("detail", F.array_min(only("d")))
    taken = F.coalesce(F.col("detail.at"), F.array().cast("array<int>"))
    free = lambda x: F.exists(x["at"], lambda p: ~F.array_contains(taken, p)) | (F.size(x["at"]) >= 2)
    named = named.withColumns({"objects": F.filter(only("o"), free), "colours": F.filter(only("c"), free)})
    whole = F.col("detail").isNotNull() & (F.size("objects") > 0) & (F.size("colours") > 0)
    pairs = F.flatten(F.transform("objects", lambda o: F.transform("colours", lambda c: F.struct(o["value"].alias("object"), c["value"].alias("colour"), (o["edits"] + c["edits"]).alias("edits")))))
    entries = tidied(catalogue).select("object", "colour", F.col("detail").alias("detail_value"), "ref_id")
    answers = (
        named.filter(whole)
        .select("phrase", F.col("detail.value").alias("detail_value"), F.inline(pairs))
        .join(small(entries), ["object", "colour", "detail_value"])
        .groupBy("phrase")
        .agg(F.collect_set(F.struct("edits", "ref_id")).alias("a"))
        .select("phrase", F.array_sort("a").alias("a"))
        .select("phrase", F.when((F.size("a") == 1) | (F.get("a", F.lit(0))["edits"] < F.get("a", F.lit(1))["edits"]), F.get("a", F.lit(0))["ref_id"]).alias("ref_id"))
    )
    return named.select("phrase", whole.alias("whole")).join(answers, "phrase", "left")


def parts_of(text: Column) -> Column:
    """The phrases a report's text lists."""
    return F.filter(F.split(text, r"(?i)\s*;\s+|\s+/\s+|(?<!\bev)\s*\.\s+|\s+samt\s+"), lambda x: F.trim(x) != "")


def taken_from(base: DataFrame, reports: DataFrame) -> DataFrame:
    """(mark_id, source, phrase): the parts of its report's text that each mark can have been taken from."""
    parts = F.transform(parts_of(F.col("symbol")), lambda p: F.struct(plain(p).alias("part"), F.trim(fold(p)).alias("whole")))
    laid = reports.select("file", "symbol").filter(F.col("symbol").isNotNull()).select("file", parts.alias("parts"))
    begun = base.withColumn("start", F.trim(fold(F.coalesce("label", F.lit(""))))).join(laid, "file")
    # The same words, then the words a label breaks off from, then words of the key.
    fits = F.transform(
        "parts",
        lambda p: F.struct(
            F.struct(
                ((F.col("said") != "") & (p["part"] == F.col("said"))).cast("int").alias("same"),
                ((F.col("start") != "") & p["whole"].startswith(F.col("start"))).cast("int").alias("begun"),
                F.size(F.array_intersect(F.split(p["part"], " "), F.split("noted", " "))).alias("shared"),
            ).alias("fit"),
            p["part"].alias("phrase"),
        ),
    )
    best = F.array_max("fits")["fit"]
    open_ = F.array_distinct(F.transform(F.filter("fits", lambda x: x["fit"] == best), lambda x: x["phrase"]))
    held = stored(begun.select("mark_id", "file", fits.alias("fits")).select("mark_id", "file", open_.alias("open")))
    several = F.size("open") > 1
    # As many phrases as one text has, whatever the number of its marks.
    claimed = held.filter(~several).groupBy("file").agg(F.collect_set(F.get("open", F.lit(0))).alias("claimed"))
    left = F.array_except("open", F.coalesce("claimed", F.array().cast("array<string>")))
    undecided = held.filter(several).join(claimed, "file", "left").select("mark_id", F.when(F.size(left) > 0, left).otherwise(F.col("open")).alias("open"))
    return held.filter(~several).select("mark_id", "open").unionByName(undecided).select("mark_id", F.lit(2).alias("source"), F.explode("open").alias("phrase"))


def assign(marks: DataFrame, reports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(mark_id, ref_id) of every mark."""
    few = catalogue.count() <= BROADCAST_ENTRIES
    reference = terms(catalogue) if few else stored(terms(catalogue))
    base = marks.select("mark_id", "file", "label", plain(F.col("label")).alias("said"), plain(F.col("key")).alias("noted"))
    own = F.array(F.struct(F.lit(0).alias("source"), F.col("said").alias("phrase")), F.struct(F.lit(1).alias("source"), F.col("noted").alias("phrase")))
    said = base.select("mark_id", F.explode(own).alias("s")).select("mark_id", "s.source", "s.phrase")
    every = stored(said.unionByName(taken_from(base, reports)).filter(F.col("phrase") != ""))
    read = every.join(read_phrases(every, reference, catalogue, few), "phrase", "left")
    # A phrase that leaves a part open says nothing, unless it is one of several the mark may have been taken from.
    entry = F.when(F.col("whole"), F.coalesce("ref_id", F.lit(UNMATCHED))).otherwise(UNMATCHED)
    told = read.groupBy("mark_id", "source").agg(F.bool_or("whole").alias("whole"), F.min(entry).alias("least"), F.max(entry).alias("most")).filter("whole")
    first = told.groupBy("mark_id").agg(F.min_by(F.when(F.col("least") == F.col("most"), F.col("least")), "source").alias("ref_id"))
    matched = stored(first.filter(F.col("ref_id") != UNMATCHED))
    unmatched = base.select("mark_id").join(matched, "mark_id", "left_anti").select("mark_id", F.lit(UNMATCHED).alias("ref_id"))
    return base.select("mark_id").join(matched, "mark_id").select("mark_id", F.col("ref_id").cast("int").alias("ref_id")).unionByName(unmatched)
