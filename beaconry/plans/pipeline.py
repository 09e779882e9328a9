"""The analysis of one data folder, every step built when it is asked for and at most once.

Steps that several others read are written as narrow tables, so that scores, plates and
marks are read from the texts once per query and not once per branch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actors, craft, identifiers, marks, places, suspects, suspicion, vehicles
from ..session import read_table, stored


class Pipeline:
    """Views over the tables of a folder; ``threshold`` is the evidence an edge between facets needs."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 1):
        self.spark, self.folder, self.threshold = spark, folder, threshold

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def reports(self) -> DataFrame:
        return self.table("reports")

    @cached_property
    def predefined(self) -> DataFrame:
        return self.table("predefined_places")

    @cached_property
    def scored(self) -> DataFrame:
        return suspicion.score(self.reports, self.predefined)

    @cached_property
    def elevated(self) -> DataFrame:
        return stored(suspicion.elevated(self.scored))

    @cached_property
    def plates(self) -> DataFrame:
        return stored(identifiers.plates(self.reports, *vehicles.TOLD))

    @cached_property
    def observations(self) -> DataFrame:
        return vehicles.observed(self.plates)

    @cached_property
    def vehicles(self) -> DataFrame:
        return vehicles.entities(self.observations)

    @cached_property
    def marks(self) -> DataFrame:
        return stored(marks.marks(self.reports))

    @cached_property
    def members(self) -> DataFrame:
        return marks.members(self.marks)

    @cached_property
    def nominations(self) -> DataFrame:
        return marks.nominations(self.marks)

    @cached_property
    def sighted(self) -> DataFrame:
        return stored(actors.facets(self.observations, self.members))

    @cached_property
    def edges(self) -> DataFrame:
        return stored(actors.edges(self.sighted, self.threshold))

    @cached_property
    def labels(self) -> DataFrame:
        return actors.label_components(self.edges)

    @cached_property
    def tied_actors(self) -> DataFrame:
        """Actors of two or more kinds of facets."""
        return stored(actors.actors(self.sighted, self.labels))

    @cached_property
    def suspect_sightings(self) -> DataFrame:
        return stored(suspects.sightings(self.reports, self.elevated))

    @cached_property
    def suspects(self) -> DataFrame:
        return suspects.suspects(self.suspect_sightings)

    @cached_property
    def lone_actors(self) -> DataFrame:
        """Suspects worth nominating that no actor has among its facets."""
        held = actors.facets_of(self.tied_actors, self.sighted, self.labels)
        return stored(suspects.hypotheses(self.suspects).join(held.select("facet"), "facet", "left_anti"))

    @cached_property
    def actors(self) -> DataFrame:
        held = actors.facets_of(self.tied_actors, self.sighted, self.labels)
        return stored(actors.merged(self.tied_actors, held, suspects.hypotheses(self.suspects)))

    @cached_property
    def actor_facets(self) -> DataFrame:
        """(actor, facet, type, label) of all actors."""
        lone = self.lone_actors.select(F.col("id").alias("actor"), "facet", F.when(F.col("vehicles") == 1, "fordon").otherwise("person").alias("type"), "label")
        return actors.facets_of(self.tied_actors, self.sighted, self.labels).unionByName(lone)

    @cached_property
    def chains(self) -> DataFrame:
        """(actor, file, tnr, tidpunkt, plats) of all actors."""
        tied = actors.chains(self.tied_actors, self.sighted, self.edges, self.labels, self.reports)
        lone = self.lone_actors.select(F.col("id").alias("actor"), F.col("facet").alias("agent"))
        return tied.unionByName(self.suspect_sightings.join(lone, "agent").select("actor", "file", "tnr", "tidpunkt", "plats"))

    @cached_property
    def claims(self) -> DataFrame:
        return stored(places.claims(self.reports, self.elevated, self.predefined))

    @cached_property
    def locations(self) -> DataFrame:
        return stored(places.locations(self.claims, self.predefined))

    @cached_property
    def craft(self) -> DataFrame:
        return craft.craft(self.reports, "tnr", "tidpunkt", "plats", "sagesman")

    @property
    def views(self) -> dict:
        """What questions are answered from."""
        names = ("reports", "elevated", "vehicles", "observations", "nominations", "members", "claims", "actors", "actor_facets", "chains", "craft")
        return {name: (lambda name=name: getattr(self, name)) for name in names} | {"places": lambda: self.locations}
