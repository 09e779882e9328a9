"""Actors: facets tied together by shared messages (GR1-GR5, J4, AG11-AG13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..session import ensure_checkpoint_dir

ROUNDS = 200


def facets(seen: DataFrame, members: DataFrame) -> DataFrame:
    """Vehicles and recurring marks as typed vertices: (facet, type, label, file), one row per sighting."""
    vehicles = seen.select(F.concat(F.lit("fordon:"), "canonical").alias("facet"), F.lit("fordon").alias("type"), F.col("canonical").alias("label"), "file")
    marks = members.select(F.concat(F.lit("marke:"), "signature").alias("facet"), F.concat(F.lit("marke:"), "object").alias("type"), F.col("signature").alias("label"), "file")
    return vehicles.unionByName(marks).distinct()


def edges(sighted: DataFrame, threshold: int = 1) -> DataFrame:
    """(a, b, weight): facets in the same message, and in how many.

    Facets of a message are few, for they are read from one short report, so the
    pairs of a message are made within its row.
    """
    baskets = sighted.groupBy("file").agg(F.array_sort(F.collect_set("facet")).alias("f")).filter(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return baskets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= max(1, threshold))


def label_components(links: DataFrame) -> DataFrame:
    """(node, root) by hash-to-min with pointer jumping; ``links`` has columns a and b, the root is the smallest node.

    A round takes each node's smallest neighbouring label and then that label's own,
    which halves chains; rounds end in checkpoints, so the plan never grows.
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root").checkpoint()
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("seen")).withColumnRenamed("a", "node")
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        nearer = F.least("root", F.coalesce("seen", "root"))
        moved = labels.join(near, "node", "left").select("node", nearer.alias("root"), F.col("root").alias("old"))
        after = moved.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old").checkpoint()
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")


def actors(sighted: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, root, facets, vehicles, marks, types): components of two or more types."""
    vertices = sighted.select(F.col("facet").alias("node"), "type", "label").distinct().join(labels, "node")
    grouped = vertices.groupBy("root").agg(
        F.count(F.lit(1)).alias("facets"),
        F.count_if(F.col("type") == "fordon").alias("vehicles"),
        F.count_if(F.col("type") != "fordon").alias("marks"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.min_by("label", "node").alias("label"),
        # An order-free digest, so that no component's members are gathered in one value.
        F.sum(F.conv(F.substring(F.md5("node"), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"),
    )
    name = F.concat(F.lit("aktor-"), F.regexp_replace("label", r"[^\p{L}\p{N}]+", "_"), F.lit("-"), F.col("facets").cast("string"), F.lit("f-"), short_hash(F.col("digest")))
    return grouped.filter(F.size("types") >= 2).select(name.alias("id"), "root", "facets", "vehicles", "marks", "types")


def chains(found: DataFrame, sighted: DataFrame, tied: DataFrame, labels: DataFrame, reports: DataFrame) -> DataFrame:
    """(actor, file, tnr, tidpunkt, plats): the messages that tie an actor's facets, one row each."""
    placed = sighted.select(F.col("facet").alias("node"), "file").join(labels, "node").join(found.select(F.col("id").alias("actor"), "root"), "root")
    # A message supports an actor if two of its facets are in it and tied strongly enough.
    pair = placed.groupBy("actor", "file").agg(F.array_sort(F.collect_set("node")).alias("f")).filter(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    support = pair.select("actor", "file", F.inline(pairs)).join(tied.select("a", "b"), ["a", "b"], "left_semi").select("actor", "file").distinct()
    return support.join(reports.select("file", "tnr", "tidpunkt", "plats"), "file").select("actor", "file", "tnr", "tidpunkt", "plats")


def spans(chain: DataFrame) -> DataFrame:
    """(actor, messages, first_seen, last_seen) of chains."""
    time = F.nullif(F.col("tidpunkt"), F.lit(""))
    return chain.groupBy("actor").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.min(time), F.lit("")).alias("first_seen"), F.coalesce(F.max(time), F.lit("")).alias("last_seen"))


def merged(found: DataFrame, vertices: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Actors and the suspects that no actor has among its facets (U2, J15): (id, root, facets, vehicles, marks, types).

    ``vertices`` has the (actor, facet) of ``found``.
    """
    alone = hypotheses.join(vertices.select("facet"), "facet", "left_anti").select(
        "id", F.col("facet").alias("root"), F.lit(1).cast("long").alias("facets"), F.col("vehicles").cast("long").alias("vehicles"), F.col("marks").cast("long").alias("marks"),
        F.array(F.when(F.col("vehicles") == 1, "fordon").otherwise("person")).alias("types"),
    )
    return found.select("id", "root", "facets", "vehicles", "marks", "types").unionByName(alone)


def facets_of(found: DataFrame, sighted: DataFrame, labels: DataFrame) -> DataFrame:
    """(actor, facet, type, label) of the actors of ``actors``."""
    vertices = sighted.select("facet", "type", "label").distinct().join(labels.withColumnRenamed("node", "facet"), "facet")
    return vertices.join(found.select(F.col("id").alias("actor"), "root"), "root").select("actor", "facet", "type", "label")


def folded(held: DataFrame, chain: DataFrame, closed: DataFrame) -> DataFrame:
    """Actors after operator merges (AG13): (actor, facets, vehicles, marks, messages, first_seen, last_seen).

    ``held`` has (actor, facet, type), ``chain`` (actor, file, tidpunkt), ``closed``
    (absorbed, survivor). A facet and a message that several merged actors have count once.
    """
    survivor = lambda df: df.join(closed.withColumnRenamed("absorbed", "actor"), "actor", "left").withColumn("actor", F.coalesce("survivor", "actor"))
    own = survivor(held).select("actor", "facet", "type").distinct()
    counted = own.groupBy("actor").agg(F.count(F.lit(1)).alias("facets"), F.count_if(F.col("type") == "fordon").alias("vehicles"), F.count_if(F.col("type") != "fordon").alias("marks"))
    steps = survivor(chain).groupBy("actor", "file").agg(F.min("tidpunkt").alias("tidpunkt"))
    return counted.join(spans(steps), "actor", "left").select("actor", "facets", "vehicles", "marks", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("first_seen", F.lit("")).alias("first_seen"), F.coalesce("last_seen", F.lit("")).alias("last_seen"))
