"""Attachments and model adapters (S13-S15, X9, X10, JS1-JS3, J17, J19, ST6).

A model only nominates. Its answers are stored by (content hash, model, prompt) and
each content is asked once. No model ships with the engine: an adapter is any
callable from contents to JSON answers, run on batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import contains_any, mark_key, plate_read
from ..session import ship_package

SIGHTING = "struct<fordon:array<struct<typ:string,marke:string,farg:string,skylt:string>>,personer:array<struct<kon:string,alder:string,klader:array<string>,utrustning:array<string>>>,ovrigt:array<string>>"
EXTRACTION = "struct<`kännetecken`:array<string>,beteenden:array<struct<begrepp:string,fras:string>>>"


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, content) of picture files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.col("path").rlike(r"(?i)\.(jpe?g|png|webp)$")).select("path", F.sha2("content", 256).alias("hash"), "content")


def comments(content: bytes | None) -> list[str]:
    """The comment segments of a JPEG, in order; none for anything else."""
    found: list[str] = []
    if not content or content[:2] != b"\xff\xd8":
        return found
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:
            break
        if kind == 0xFE:
            found.append(content[at + 4 : at + 2 + size].decode("utf-8", "replace"))
        at += 2 + size
    return found


def embedded_plates(pictures: DataFrame, marker: str = "PLATE:") -> DataFrame:
    """(path, plate) written into a picture's comments; binary segments are beyond SQL, so batches of bytes go to Python."""
    ship_package(pictures.sparkSession)

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[c[len(marker) :].strip() for c in comments(x) if c.startswith(marker)] for x in batch], dtype=object)

    plates = pictures.select("path", F.explode(read("content")).alias("plate"))
    return plates.select("path", plate_read(F.col("plate")).alias("plate")).filter(F.col("plate").rlike(f"^{V.PLATE}$"))


def asked_once(contents: DataFrame, cache: DataFrame, model: str, prompt: str, ask: Callable[[list], list[str | None]], column: str) -> DataFrame:
    """(hash, model, prompt, answer) of contents that the cache does not have; failed answers are left out, to be tried again."""
    have = cache.filter((F.col("model") == model) & (F.col("prompt") == prompt)).select("hash")
    open_ = contents.dropDuplicates(["hash"]).join(have, "hash", "left_anti").select("hash", column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hash": batch["hash"], "answer": ask(batch[column].tolist())})

    answers = open_.mapInPandas(run, "hash string, answer string").filter(F.col("answer").isNotNull())
    return answers.select("hash", F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), "answer")


def parsed(answer: Column, schema: str) -> Column:
    """A JSON answer, or the JSON between the first and last brace of a chatty one."""
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.from_json(inner, schema, {"mode": "PERMISSIVE"}))


def known(value: Column) -> Column:
    """A value of a sighting; unknown ones are null."""
    bare = F.trim(value)
    return F.when(~F.lower(bare).isin("", "-", "okänd", "okänt"), bare)


def sighting_nominations(answers: DataFrame) -> DataFrame:
    """(hash, kind, text, conflict) of sightings: plates once each, vehicles and persons described.

    Two different plates read from one picture contradict each other.
    """
    seen = answers.select("hash", parsed(F.col("answer"), SIGHTING).alias("s")).filter(F.col("s").isNotNull())
    vehicles = seen.select("hash", F.explode("s.fordon").alias("v"))
    plates = vehicles.select("hash", plate_read(F.col("v.skylt")).alias("text")).filter(F.col("text").rlike(f"^{V.PLATE}$")).distinct()
    several = plates.groupBy("hash").agg((F.count(F.lit(1)) > 1).alias("conflict"))
    words = lambda *cs: F.concat_ws(" ", *[known(c) for c in cs])
    described = vehicles.select("hash", words(F.col("v.farg"), F.col("v.marke"), F.col("v.typ")).alias("text"))
    persons = seen.select("hash", F.explode("s.personer").alias("p")).select(
        "hash", F.concat_ws(", ", known(F.col("p.kon")), known(F.col("p.alder")), F.array_join("p.klader", ", "), F.array_join("p.utrustning", ", ")).alias("text")
    )
    no = F.lit(False)
    return (
        plates.join(several, "hash").select("hash", F.lit("plate").alias("kind"), "text", "conflict")
        .unionByName(described.select("hash", F.lit("vehicle").alias("kind"), "text", no.alias("conflict")))
        .unionByName(persons.select("hash", F.lit("person").alias("kind"), "text", no.alias("conflict")))
        .filter(F.col("text") != "")
    )


def recon_behaviours(answers: DataFrame) -> DataFrame:
    """(hash, key, label, weight) of behaviours that equipment, clothes and remarks show; of several of one kind the strongest, then the first listed."""
    seen = answers.select("hash", parsed(F.col("answer"), SIGHTING).alias("s")).filter(F.col("s").isNotNull())
    none = F.array().cast("array<string>")
    worn = F.flatten(F.transform(F.coalesce("s.personer", F.array().cast("array<struct<kon:string,alder:string,klader:array<string>,utrustning:array<string>>>")), lambda p: F.concat(F.coalesce(p["utrustning"], none), F.coalesce(p["klader"], none))))
    said = seen.select("hash", F.lower(F.array_join(F.concat(worn, F.coalesce("s.ovrigt", none)), " ")).alias("said"))
    shown = F.array(*[
        F.when(F.expr(contains_any("said", words)), F.struct(F.lit(f"beteende:{key}").alias("key"), F.lit(f"hotindikator (foto): {name}").alias("label"), F.lit(weight).alias("weight"), F.lit(-turn).alias("turn")))
        for turn, (words, key, name, weight) in enumerate(V.PICTURE_BEHAVIOURS)
    ])
    rows = said.select("hash", F.inline(F.array_compact(shown)))
    return rows.groupBy("hash", "key").agg(F.max_by("label", F.struct("weight", "turn")).alias("label"), F.max("weight").alias("weight"))


def text_findings(answers: DataFrame) -> DataFrame:
    """(hash, kind, key, label) of extractions: marks once per key, behaviours of the known concepts once each."""
    got = answers.select("hash", parsed(F.col("answer"), EXTRACTION).alias("e")).filter(F.col("e").isNotNull())
    marks = got.select("hash", F.posexplode("e.kännetecken").alias("at", "label")).select("hash", F.lit("mark").alias("kind"), mark_key(F.col("label")).alias("key"), "label", "at")
    concepts = [i.key for i in V.INDICATORS]
    acts = got.select("hash", F.posexplode("e.beteenden").alias("at", "b")).select("hash", F.lit("behaviour").alias("kind"), F.col("b.begrepp").alias("key"), F.col("b.fras").alias("label"), "at")
    every = marks.filter(F.col("key") != "").unionByName(acts.filter(F.col("key").isin(concepts)))
    return every.groupBy("hash", "kind", "key").agg(F.min_by("label", "at").alias("label"))


def pending(findings: DataFrame, confirmed: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """Findings no one has decided on."""
    return findings.join(confirmed, list(keys), "left_anti").join(rejected, list(keys), "left_anti")


def corroboration(photo: DataFrame, typed: DataFrame) -> DataFrame:
    """(file, plate, state) of plates read from pictures against those a report names: confirmed, conflict or none."""
    own = typed.groupBy("file").agg(F.collect_set("plate").alias("named"))
    return photo.join(own, "file", "left").select(
        "file", "plate", F.when(F.array_contains("named", F.col("plate")), "confirmed").when(F.size(F.coalesce("named", F.array().cast("array<string>"))) > 0, "conflict").otherwise("none").alias("state")
    )
