"""Kinds of craft that reports mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import SWEDISH, contains_any, quoted
from .identifiers import with_items


def prose() -> Column:
    """What a report says about things: event and symbol, as two sentences."""
    return F.concat_ws(". ", F.nullif(F.col("handelse"), F.lit("")), F.nullif(F.col("symbol"), F.lit("")))


def kinds(column: str) -> Column:
    """The kinds a column of lower-case text names, in the taxonomy's order, each once."""
    found = []
    for c in V.CRAFTS:
        # The pattern is only tried where a plain search finds one of its words.
        pattern = f"(?<![{SWEDISH}])(?:{'|'.join(c.words)})(?![{SWEDISH}])"
        whole = f"({contains_any(column, c.words)} and rlike({column}, {quoted(pattern)}))"
        named = f"({contains_any(column, c.stems)} or {whole})" if c.stems else whole
        item = f"named_struct('type', {quoted(c.key)}, 'medium', {quoted(c.medium)}, 'plated', {str(c.plated).lower()}, 'threat', {c.threat})"
        found.append(f"if({named}, {item}, null)")
    return F.expr(f"array_compact(array({', '.join(found)}))")


def kind_of(column: str) -> Column:
    """The first kind a column of lower-case labels names, else null."""
    return F.get(kinds(column), F.lit(0))["type"]


def craft(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per report and kind: (file, *keep, type, label, medium, plated, threat, plate).

    A plated craft is tied to the report's whole plate if there is exactly one.
    """
    base = with_items(reports, "handelse", "symbol", *keep).withColumn("text", F.lower(prose()))
    whole = F.array_distinct(F.transform(F.filter("items", lambda i: (i["type"] == "plate") & ~i["partial"]), lambda i: i["value"]))
    found = base.select("file", *keep, kinds("text").alias("kinds"), F.when(F.size(whole) == 1, whole[0]).alias("sole"))
    rows = found.select("file", *keep, "sole", F.inline_outer("kinds")).filter(F.col("type").isNotNull())
    return rows.select("file", *keep, "type", F.col("type").alias("label"), "medium", "plated", "threat", F.when(F.col("plated"), F.col("sole")).alias("plate"))
