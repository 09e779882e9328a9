"""Named queries over the training-data operators, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import misreadings
from ..session import read_table
from . import byte_bpe, canonical, components, cooccurrence, leakage, quality

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.assign(read_table(spark, d, "text_marks"), read_table(spark, d, "reports"), read_table(spark, d, "mark_catalogue"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that no entry of the reference list means, and how often each was typed."""
    missing = p2_found(spark, d).filter(F.col("ref_id") == canonical.UNMATCHED).select("mark_id")
    marks = read_table(spark, d, "text_marks").select("mark_id", "label")
    return marks.join(missing, "mark_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    baskets = cooccurrence.sightings(read_table(spark, d, "facets"), read_table(spark, d, "chain_steps"))
    return cooccurrence.together(baskets).select(F.col("item_a").alias("facet_a"), F.col("item_b").alias("facet_b"))


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    baskets = cooccurrence.sightings(read_table(spark, d, "facets"), read_table(spark, d, "chain_steps"))
    return cooccurrence.together(baskets).select("item_a", "item_b", "n", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.components(components.links(read_table(spark, d, "evidence_edges")))
    return groups.select(F.col("node").alias("facet_id"), F.col("root").alias("group_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.token_ids(read_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    shapes = quality.shapes(read_table(spark, d, "documents"))
    return shapes.filter(F.col("shape") != "prose").select("doc_id", "shape")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The figures of every document, by name."""
    measured = quality.statistics(read_table(spark, d, "documents"))
    return measured.select("doc_id", *[F.round(F.get("f", F.lit(i)).cast("double"), 4).alias(name) for i, name in enumerate(quality.FIGURES)])


BASKETS_SQL = """WITH o AS (SELECT DISTINCT r, i FROM (
  SELECT unnest(files) AS r, facet_id AS i FROM facets UNION ALL SELECT file, unnest(facets) FROM chain_steps)
  WHERE r IS NOT NULL AND i IS NOT NULL),
tot AS (SELECT count(DISTINCT r) AS big FROM o),
c AS (SELECT i, count(*) AS n FROM o GROUP BY i),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM o x JOIN o y ON x.r = y.r AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5)
"""
PAIRS_SQL = " FROM p JOIN c ca ON ca.i = p.a JOIN c cb ON cb.i = p.b, tot WHERE p.n * tot.big >= 5 * ca.n * cb.n"


def _words_sql(table: str, key: str) -> str:
    """The folded words of a table's texts, in SQL."""
    text = "regexp_replace(text, '</?[A-Za-z][^<>]{0,80}>', ' ', 'g')"
    for misread, letter in misreadings():
        text = f"replace({text}, '{misread}', '{letter}')" if "'" not in misread else text
    return rf"SELECT {key}, regexp_extract_all(strip_accents(lower(replace({text}, chr(8203), ''))), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"


def _runs_sql(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM ({_words_sql(table, key)}) WHERE len(w) >= 13)"


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        "p2_unmatched": p2_unmatched,
        "p3_found": p3_found,
        "p3_lift": p3_lift,
        "p5_found": p5_found,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p9_found": p9_found,
        "p9_statistics": p9_statistics,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs_sql('documents', 'doc_id')}) d JOIN ({_runs_sql('eval_items', 'item_id')}) i USING (g)",
        "p3_found": BASKETS_SQL + "SELECT p.a AS facet_a, p.b AS facet_b" + PAIRS_SQL,
        "p3_lift": BASKETS_SQL
        + "SELECT p.a AS item_a, p.b AS item_b, p.n AS n, ca.n AS n_a, cb.n AS n_b, round(p.n * tot.big / (ca.n * cb.n), 6) AS lift"
        + PAIRS_SQL,
        "p5_found": """WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM evidence_edges WHERE weight >= 2 AND a <> b
  UNION SELECT b, a FROM evidence_edges WHERE weight >= 2 AND a <> b),
reach AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
SELECT u AS facet_id, min(v) AS group_id FROM reach GROUP BY u""",
    }
