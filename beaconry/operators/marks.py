"""Distinctive marks read from prose, and recurring ones (X4, X5, AG3).

A report is cut into clauses. A clause opens a mark (a rare item, an object, a
decal at the rear), adds details to the open one, or closes it. Numbering the
clauses that open or close gives islands: an island led by an opener is one mark,
whose following clauses are its details. All of it happens in the report's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import any_of, bounded, contains_any, edged, first_of, quoted
from .craft import prose

ATTRS = "array<struct<dim:string,value:string>>"


def clauses() -> Column:
    """The clauses of a report's event and symbol, links left out."""
    text = F.regexp_replace(prose(), r"!?\[\[[^\]]*\]\]", " ")
    parts = F.split(text, "(?i)[.,]|" + bounded("och|samt"))
    return F.filter(F.transform(parts, F.trim), lambda c: c != "")


def attributes(column: str) -> Column:
    """(dim, value) pairs that a column of lower-case clauses shows."""
    has = lambda words: contains_any(column, tuple(words))
    tests = []
    for colour in dict.fromkeys(c for _, c in V.MARK_COLOURS):
        words = tuple(w for w, c in V.MARK_COLOURS if c == colour)
        tests.append((f"({has(words)} and rlike({column}, {quoted(edged(words))}))", "farg", colour))
    tests.append((has(V.MARKINGS), "marking", "ja"))
    for optic in dict.fromkeys(t for _, t in V.OPTIC_TYPES):
        tests.append((has(w for w, t in V.OPTIC_TYPES if t == optic), "typ", optic))
    tests += [(has(V.UNCLEAR), "synlighet", "otydlig"), (has(V.REAR), "position", "bak")]
    tests += [(f"(contains({column}, {quoted(w)}) and rlike({column}, {quoted(bounded(w))}))", "text", w.upper()) for w in ("tac", "dge")]
    found = [f"if({test}, named_struct('dim', {quoted(d)}, 'value', {quoted(v)}), null)" for test, d, v in tests]
    return F.expr(f"array_compact(array({', '.join(found)}))").cast(ATTRS)


def classified(reports: DataFrame) -> DataFrame:
    """(file, ..., at, clause, opens, boundary, negated, attrs): every clause and what it does."""
    rows = reports.select("file", "tnr", "tidpunkt", "plats", "sagesman", F.posexplode_outer(clauses()).alias("at", "clause")).filter(F.col("clause").isNotNull()).withColumn("lower", F.lower("clause"))
    item = first_of("lower", [(w, f"named_struct('object', {quoted(c)}, 'item', {quoted(i)})") for w, c, i in V.RARE_ITEMS])
    thing = first_of("lower", [(w, quoted(o)) for w, o in V.MARK_OBJECTS])
    rows = rows.withColumns({"item": item, "thing": thing, "attrs": attributes("lower"), "negated": any_of("lower", V.NEGATIONS) & F.col("lower").rlike(bounded("|".join(V.NEGATIONS)))})
    decal = any_of("lower", V.MARKINGS) & any_of("lower", V.REAR)
    opens = F.coalesce(F.col("item.object"), F.col("thing"), F.when(decal, F.lit("fordon-dekal")))
    detail = ~any_of("lower", V.GENERIC) & ~F.col("negated") & (F.size("attrs") > 0)
    own = F.when(F.col("item").isNotNull(), F.array(F.struct(F.lit("item").alias("dim"), F.col("item.item").alias("value"))).cast(ATTRS)).otherwise(F.col("attrs"))
    return rows.select(
        "file", "tnr", "tidpunkt", "plats", "sagesman", "at", "clause", opens.alias("opens"), (opens.isNotNull() | ~detail).alias("boundary"), "negated", own.alias("attrs")
    )


def signature(object_: Column, attrs: Column) -> Column:
    """The identity of a mark: its object and the values of the object's identity dimensions."""
    values = lambda dim: F.array_join(F.array_sort(F.transform(F.filter(attrs, lambda a: a["dim"] == dim), lambda a: a["value"])), ",")
    parts = None
    for name, dims in V.SIGNATURE_DIMS.items():
        joined = F.array_join(F.filter(F.array(*[F.when(values(d) != "", F.concat(F.lit(d + ":"), values(d))) for d in dims]), lambda x: x.isNotNull()), "|")
        parts = F.when(object_ == name, joined) if parts is None else parts.when(object_ == name, joined)
    return F.concat(object_, F.lit("#"), parts)


def distinctive(object_: Column, attrs: Column) -> Column:
    """Whether every identity dimension of the object is known."""
    has = lambda dim: F.exists(attrs, lambda a: a["dim"] == dim)
    out = F.lit(False)
    for name, dims in V.SIGNATURE_DIMS.items():
        all_ = F.lit(True)
        for d in dims:
            all_ = all_ & has(d)
        out = out | ((object_ == name) & all_)
    return out


def marks(reports: DataFrame) -> DataFrame:
    """One row per mark: (file, tnr, tidpunkt, plats, sagesman, turn, object, attrs, signature, distinctive, clauses)."""
    # Clauses of one report only, so the window is as small as a report.
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    islands = classified(reports).withColumn("turn", F.sum(F.col("boundary").cast("int")).over(order))
    led = islands.groupBy("file", "turn").agg(
        *[F.first(c).alias(c) for c in ("tnr", "tidpunkt", "plats", "sagesman")],
        F.min_by("opens", F.struct("at")).alias("object"),
        F.min_by("negated", F.struct("at")).alias("negated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("attrs")))).alias("attrs"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "clause"))), lambda x: x["clause"]).alias("clauses"),
    )
    kept = led.filter((F.col("turn") > 0) & F.col("object").isNotNull() & ~F.col("negated")).drop("negated")
    return kept.withColumns({"signature": signature(F.col("object"), F.col("attrs")), "distinctive": distinctive(F.col("object"), F.col("attrs"))})


def label(object_: Column, attrs: Column) -> Column:
    """A mark in words."""
    noun = F.create_map(*[F.lit(x) for pair in V.MARK_NOUNS.items() for x in pair])
    values = lambda *dims: F.transform(F.filter(attrs, lambda a: a["dim"].isin(*dims)), lambda a: a["value"])
    has = lambda dim: F.exists(attrs, lambda a: a["dim"] == dim)
    extras = F.concat(
        F.array_compact(F.array(F.when(has("marking"), "märke"), F.when(has("synlighet"), "otydligt"), F.when(has("position"), "bak"))),
        values("typ", "item"),
        F.when(has("text"), F.array(F.array_join(values("text"), "/"))).otherwise(F.array().cast("array<string>")),
    )
    head = F.concat_ws(" ", F.nullif(F.array_join(values("farg"), "/"), F.lit("")), F.element_at(noun, object_))
    return F.when(F.size(extras) > 0, F.concat(head, F.lit(" ("), F.array_join(extras, ", "), F.lit(")"))).otherwise(head)


def members(found: DataFrame) -> DataFrame:
    """Distinctive marks, one per signature and report, of signatures seen in two reports or more."""
    order = F.struct("tidpunkt", "tnr", "file", "turn")
    whole = F.struct("tidpunkt", "tnr", "file", "turn", "object", "attrs", "plats", "sagesman")
    first = found.filter("distinctive").groupBy("signature", "file").agg(F.min_by(whole, order).alias("m"))
    counted = first.groupBy("signature").agg(F.count(F.lit(1)).alias("seen")).filter("seen >= 2").select("signature")
    return first.join(counted, "signature").select("signature", "m.*")


def nominations(found: DataFrame) -> DataFrame:
    """Recurring marks: (signature, object, label, count, first_seen, last_seen, observers)."""
    each = members(found)
    time = F.nullif(F.col("tidpunkt"), F.lit(""))
    grouped = each.groupBy("signature").agg(
        F.min_by("object", F.struct("tidpunkt", "tnr", "file")).alias("object"),
        F.min_by("attrs", F.struct("tidpunkt", "tnr", "file")).alias("attrs"),
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min(time), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(time), F.lit("")).alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif(F.col("sagesman"), F.lit("")))).alias("observers"),
    )
    return grouped.select("signature", "object", label(F.col("object"), F.col("attrs")).alias("label"), "count", "first_seen", "last_seen", "observers")
