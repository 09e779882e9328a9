"""Keyword questions as plans (QL1-QL6).

A sentence is cut into tokens and laid against one table of cues. Each cue fills a
slot with a value at a rank; of a slot's cues the lowest rank stays. Slots that need
what follows a cue (a place, an observer, hours, a number) are filled from the tokens
after it. Rules then turn the slots into a question, and a table of executors turns a
question into one DataFrame; only the views it needs are built. Identity questions
are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import in_window, minute_of_day, reason_phrases

Views = dict[str, Callable[[], DataFrame]]


class Cue(NamedTuple):
    """Tokens in sequence that put a value into a slot; a lower rank wins."""

    words: str
    slot: str
    value: object = True
    rank: int = 0


def _cues(slot: str, value: object, rank: int, words: str) -> list[Cue]:
    return [Cue(w, slot, value, rank) for w in words.split(", ")]


# The words that steer a question, and what comes before what.
CUES: list[Cue] = [
    *_cues("target", "larm", 0, "larm, larmen, hot, hotbild, misstänkta, misstanke, varning, varningar, misstänkt"),
    *_cues("target", "aktor", 1, "aktör, aktörer, aktören, misstänkt person, agent, gärningsman"),
    *_cues("target", "plats", 2, "plats, platser, platsen, hotspot, hotspots, område, områden"),
    *_cues("target", "kannetecken", 3, "kännetecken, märke, märken, ryggsäck, keps, mössa, dekal, optik, kikare"),
    *_cues("target", "fordon", 4, "fordon, bil, bilar, plåt, plåtar, regplåt, regplåtar, reg, registreringsskylt, registreringsnummer, nummerplåt"),
    *_cues("shape", "summary", 0, "sammanfatta, sammanfattning, läget, lägesbild, översikt, överblick, summering, summera"),
    *_cues("shape", "timeline", 1, "tidslinje, tidslinjen, kronologi, kronologisk, tidsordning, förlopp"),
    *_cues("shape", "list", 2, "vilka, lista, alla, heta, hetast, hetaste, antal, flest"),
    *_cues("shape", "detail", 3, "visa, detalj, detaljer, beskriv, berätta"),
    *_cues("period", (1320, 300), 0, "natt, nattetid, inatt"),
    *_cues("period", (300, 540), 1, "morgon"),
    *_cues("period", (360, 1080), 2, "dag, dagtid"),
    *_cues("period", (1080, 1320), 3, "kväll"),
    *_cues("recurring", True, 0, "återkommande, upprepad, upprepade, återkommer, flera gånger, mer än en gång"),
    *_cues("least", True, 0, "minst, mer än"),
    *_cues("hours", True, 0, "mellan, kl, klockan"),
    *_cues("place", True, 0, "vid, nära, plats, sektor, kring, runt"),
    *_cues("observer", True, 0, "från, av, sägesman, sagesman"),
    *_cues("entity", True, 0, "entitet"),
    *_cues("same", True, 0, "samma"),
    *_cues("likeness", True, 0, "är, aktör, person, fordon, ?"),
    # What ends the name of a place.
    *_cues("stop", True, 0, "natt, nattetid, inatt, morgon, dag, dagtid, kväll, mellan, kl, klockan, återkommande, fordon, farkost, märke, märken, aktör, aktörer, larm, sammanfatta, natten, i, på, och, från, av"),
    # What is no observer's sign.
    *_cues("unsigned", True, 0, "en, ett, den, det, de, dem, alla, några, någon, min, vår"),
]
#: How words about reporting begin.
TELLING = ("rapport", "observ", "sett", "sagt", "säger", "inrapport", "meddelat")
TOKEN = re.compile(r"[a-zåäö0-9]+|[^\sa-zåäö0-9]")


def _craft_cues() -> list[Cue]:
    asked = [c for c in V.CRAFTS if c.cue]
    return [Cue(w, "craft", c.key, i) for i, c in enumerate(asked) for w in c.words]


def _table() -> dict[tuple[str, ...], list[Cue]]:
    table: dict[tuple[str, ...], list[Cue]] = {}
    for cue in CUES + _craft_cues():
        table.setdefault(tuple(cue.words.split()), []).append(cue)
    return table


TABLE = _table()
LONGEST = max(map(len, TABLE))


class Hit(NamedTuple):
    """A cue in a sentence: the token it starts at and the one after it."""

    cue: Cue
    start: int
    end: int


@dataclass(frozen=True)
class Question:
    shape: str
    target: str
    term: str | None = None
    least: int | None = None
    window: tuple[int, int] | None = None
    place: str | None = None
    observer: str | None = None
    guard: bool = False

    @property
    def narrowed(self) -> bool:
        return bool(self.window or self.place or self.observer)


class Sentence:
    """Tokens of a question and the cues among them."""

    def __init__(self, raw: str):
        self.raw, self.text = raw, raw.lower()
        found = list(TOKEN.finditer(self.text))
        self.tokens = [m[0] for m in found]
        self.spans = [m.span() for m in found]
        self.hits = [
            Hit(cue, i, i + n) for i in range(len(found)) for n in range(1, LONGEST + 1) for cue in TABLE.get(tuple(self.tokens[i : i + n]), ()) if i + n <= len(found)
        ]
        stems = [(rank, c.key, s) for rank, c in enumerate(c for c in V.CRAFTS if c.cue) for s in c.stems]
        self.hits += [Hit(Cue(t, "craft", key, rank), i, i + 1) for i, t in enumerate(self.tokens) for rank, key, s in stems if s in t]

    def all(self, slot: str) -> list[Hit]:
        return [h for h in self.hits if h.cue.slot == slot]

    def best(self, slot: str):
        found = self.all(slot)
        return min(found, key=lambda h: (h.cue.rank, h.start)).cue.value if found else None

    def clock(self, at: int) -> tuple[int, int] | None:
        """Minutes of a clock time written from a token on, and the token after it."""
        part = lambda i: self.tokens[i] if i < len(self.tokens) else ""
        if not re.fullmatch(r"\d{1,2}", part(at)):
            return None
        with_minutes = part(at + 1) == ":" and re.fullmatch(r"\d{2}", part(at + 2))
        return int(part(at)) % 24 * 60 + (int(part(at + 2)) % 60 if with_minutes else 0), at + (3 if with_minutes else 1)

    def hours(self) -> tuple[int, int] | None:
        for hit in self.all("hours"):
            start = hit.end + (self.tokens[hit.end : hit.end + 1] == ["."])
            first = self.clock(start)
            if first and self.tokens[first[1] : first[1] + 1] and self.tokens[first[1]] in ("och", "-", "–", "till"):
                second = self.clock(first[1] + 1)
                if second:
                    return first[0], second[0]
        return None

    def place(self) -> str | None:
        """The words after a place cue, up to what ends a name."""
        stops = sorted(h.start for h in self.all("stop"))
        for hit in sorted(self.all("place"), key=lambda h: h.start):
            last = next((s for s in stops if s >= hit.end), len(self.tokens))
            if last > hit.end:
                named = self.text[self.spans[hit.end][0] : self.spans[last - 1][1]].rstrip("?.!,").strip()
                if len(named) >= 2:
                    return named
        return None

    def observer(self) -> str | None:
        """A short sign after a cue of source, else a sign ending in Q in a sentence about reporting."""
        unsigned = {h.start for h in self.all("unsigned")}
        for hit in sorted(self.all("observer"), key=lambda h: h.start):
            if hit.end < len(self.tokens) and hit.end not in unsigned and re.fullmatch(r"[a-zåäö0-9]{1,4}", self.tokens[hit.end]):
                return self.tokens[hit.end].upper()
        if any(t.startswith(TELLING) for t in self.tokens):
            return next((t.upper() for t in self.tokens if re.fullmatch(r"[a-zåäö]{1,2}q", t)), None)
        return None

    def number(self) -> int | None:
        following = (self.tokens[h.end] for h in self.all("least") if h.end < len(self.tokens))
        return next((int(t) for t in following if t.isdigit()), None)

    def entity(self) -> str | None:
        named = [self.tokens[h.end] for h in self.all("entity") if h.end < len(self.tokens)]
        plate = re.search(rf"(?<![A-Za-z0-9_])({V.PLATE})(?![A-Za-z0-9_])", self.raw)
        return (named[0] if named else plate[1] if plate else "").upper() or None


def parse(raw: str) -> Question:
    """What a question asks for: refusal before entity before recurrence before shape."""
    said = Sentence(raw)
    craft = said.best("craft")
    slots = {"window": said.hours() or said.best("period"), "place": said.place(), "observer": said.observer()}
    target = "farkost" if craft else said.best("target") or "alla"
    rules: list[tuple[object, Callable[[], Question]]] = [
        (said.best("same") and said.best("likeness"), lambda: Question("detail", target, guard=True, **slots)),
        (said.entity(), lambda: Question("detail", "fordon", term=said.entity(), **slots)),
        (said.best("recurring"), lambda: Question("list", target, least=max(2, said.number() or 2), **slots)),
        (craft, lambda: Question(said.best("shape") or "list", target, term=craft, **slots)),
    ]
    for holds, made in rules:
        if holds:
            return made()
    plain = Question(said.best("shape") or "list", target, **slots)
    free = said.text.strip().rstrip("?.!").strip()
    return plain if plain.narrowed or target != "alla" else Question(plain.shape, target, term=free)


def clock(minutes: int) -> str:
    return f"{minutes // 60:02}:{minutes % 60:02}"


def echo(q: Question) -> str:
    """How a question was understood, in one line."""
    parts = {"mål": q.target, "form": q.shape, "term": q.term and f'"{q.term}"', "minst": q.least, "tid": q.window and f"{clock(q.window[0])}–{clock(q.window[1])}", "observatör": q.observer}
    told = [f"{name}={value}" for name, value in parts.items() if value] + ([f'plats~"{q.place}"'] if q.place else [])
    return ", ".join((["identitetsspärr"] if q.guard else []) + told)


# --- executors --------------------------------------------------------------

REFUSAL = "Identitetsfrågor besvaras inte: de avgörs med evidens och operatörens bekräftelse."
#: How many a report of the situation or of a place names.
TOP_ALARMS, TOP_PLACES, TOP_CRAFT, PLACE_ALARMS, PLACE_CRAFT = 5, 3, 5, 6, 10


def conditions(q: Question) -> Column:
    """The question's filters on reports and what derives from them."""
    test = F.lit(True)
    if q.window:
        test = test & in_window(minute_of_day(F.col("tidpunkt")), *q.window)
    if q.place:
        test = test & F.lower("plats").contains(q.place)
    if q.observer:
        test = test & F.upper("sagesman").contains(q.observer)
    return test


def rows(df: DataFrame, part: str, ref: str, text: Column | None = None, n: Column | None = None, time: str | None = None) -> DataFrame:
    """One part of an answer: (part, ref, text, n, tidpunkt)."""
    return df.select(
        F.lit(part).alias("part"), F.col(ref).cast("string").alias("ref"), F.coalesce(text if text is not None else F.lit(""), F.lit("")).alias("text"),
        F.coalesce(n if n is not None else F.lit(1), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(time) if time else F.lit(""), F.lit("")).alias("tidpunkt"),
    )


def mentions(term: str) -> Column:
    """Whether a report has a term in event, symbol, place or a link."""
    has = lambda c: F.coalesce(F.lower(c).contains(term), F.lit(False))
    return has("handelse") | has("symbol") | has("plats") | F.coalesce(F.exists("links", lambda x: F.lower(x["raw"]).contains(term)), F.lit(False))


def with_plate() -> Column:
    """Whether a report links a plate."""
    return F.coalesce(F.exists("links", lambda x: x["kind"].isin("plate-full", "plate-partial")), F.lit(False))


def refusal(q: Question, views: Views) -> DataFrame:
    one = views["reports"]().sparkSession.range(1)
    return rows(one.select(F.lit("").alias("ref")), "spärr", "ref", F.lit(REFUSAL), F.lit(0))


def observations(q: Question, views: Views) -> DataFrame:
    """Reports under the question's filters; of vehicles those that link a plate, of marks those that show a confirmed one."""
    found = views["reports"]().filter(conditions(q))
    if q.target == "fordon":
        found = found.filter(with_plate())
    if q.target == "kannetecken":
        found = found.join(views["members"]().select("file").distinct(), "file", "left_semi")
    return rows(found, "observation", "file", F.col("plats"), time="tidpunkt")


def search(q: Question, views: Views) -> DataFrame:
    long_enough = F.lit(len(q.term or "") >= 2)
    return rows(views["reports"]().filter(long_enough & mentions((q.term or "").lower()) & conditions(q)), "träff", "file", F.col("plats"), time="tidpunkt")


def searched_or_listed(q: Question, views: Views) -> DataFrame:
    return search(q, views) if q.term else observations(q, views)


def typed_vehicles(views: Views) -> DataFrame:
    """Vehicles with the kinds of craft their plate was seen as."""
    kinds = views["craft"]().filter(F.col("plate").isNotNull()).groupBy(F.col("plate").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_set("label")), "/").alias("kinds"))
    return views["vehicles"]().join(kinds, "canonical", "left")


def vehicles(q: Question, views: Views) -> DataFrame:
    if q.least is None and q.narrowed:
        return observations(q, views)
    return rows(typed_vehicles(views).filter(F.col("count") >= (q.least or 1)), "fordon", "canonical", F.col("kinds"), F.col("count"), "last_seen")


def marks(q: Question, views: Views) -> DataFrame:
    if q.least is None and q.narrowed and q.shape == "list":
        return observations(q, views)
    return rows(views["nominations"]().filter(F.col("count") >= (q.least or 1)), "kännetecken", "signature", F.col("label"), F.col("count"), "last_seen")


def recurring(q: Question, views: Views) -> DataFrame:
    """Vehicles and marks seen often enough."""
    return rows(views["vehicles"]().filter(F.col("count") >= q.least), "fordon", "canonical", None, F.col("count"), "last_seen").unionByName(marks(q, views))


def reports(q: Question, views: Views) -> DataFrame:
    return recurring(q, views) if q.least else searched_or_listed(q, views)


def mark_dossier(term: str, views: Views) -> DataFrame:
    """The sightings of the first mark that has a term in signature or label."""
    hit = F.lower("signature").contains(term.lower()) | F.lower("label").contains(term.lower())
    first = views["nominations"]().filter(hit).orderBy("object", "signature").limit(1).select("signature")
    return rows(views["members"]().join(F.broadcast(first), "signature", "left_semi"), "kännetecken", "file", F.col("plats"), time="tidpunkt")


def vehicle_detail(q: Question, views: Views) -> DataFrame:
    """A vehicle's sightings, else those of a mark of that name."""
    seen = views["observations"]().filter(F.upper("canonical") == (q.term or "").upper())
    if q.term and seen.isEmpty():
        return mark_dossier(q.term, views)
    return rows(seen, "fordon", "file", F.col("canonical"), time="tidpunkt")


def mark_detail(q: Question, views: Views) -> DataFrame:
    if q.term:
        found = mark_dossier(q.term, views)
        if not found.isEmpty():
            return found
    return marks(q, views)


def actors(q: Question, views: Views) -> DataFrame:
    return rows(views["actors"](), "aktör", "id", F.array_join("types", ","), F.col("facets"))


def actor_detail(q: Question, views: Views) -> DataFrame:
    """Facets and messages of the first actor (most facets, then id) that has the term in its id or a facet's label."""
    if not q.term:
        return actors(q, views)
    term = q.term.lower()
    held = views["actor_facets"]()
    hit = held.filter(F.lower("actor").contains(term) | F.lower("label").contains(term)).select(F.col("actor").alias("id")).distinct()
    first = views["actors"]().join(hit, "id", "left_semi").orderBy(F.col("facets").desc(), "id").limit(1).select(F.col("id").alias("actor"))
    of = lambda df: df.join(F.broadcast(first), "actor", "left_semi")
    return rows(of(held), "facett", "facet", F.col("type")).unionByName(rows(of(views["chains"]()), "kedja", "file", F.col("plats"), time="tidpunkt"))


def places(q: Question, views: Views) -> DataFrame:
    return rows(views["places"](), "plats", "place", F.when(F.col("predefined"), "fördefinierad").otherwise(""), F.col("reports"))


def place_found(term: str, views: Views) -> DataFrame:
    """The first place (most elevated, most reports, name) that has a term in its name: one row or none."""
    hit = views["places"]().filter(F.lower("place").contains(term.lower()))
    return hit.orderBy(F.col("elevated").desc(), F.col("reports").desc(), "place").limit(1)


def place_detail(q: Question, views: Views) -> DataFrame:
    key = q.place or q.term
    if not key:
        return places(q, views)
    first = place_found(key, views).select("place")
    told = F.concat_ws(" ", F.when(F.col("elevated"), "⚠"), F.array_join("plates", ", "))
    found = rows(views["claims"]().join(F.broadcast(first), "place", "left_semi"), "observation", "file", told, time="tidpunkt")
    return places(q, views) if first.isEmpty() else found


def alarms(q: Question, views: Views) -> DataFrame:
    return rows(views["elevated"]().filter(conditions(q)), "larm", "file", F.array_join(reason_phrases(F.col("reasons")), ", "), F.col("score"), "tidpunkt")


def craft_seen(q: Question, views: Views) -> DataFrame:
    """Sightings of craft, marked where the report is elevated."""
    found = views["craft"]().filter(conditions(q))
    if q.term:
        found = found.filter(F.col("type") == q.term)
    flagged = found.join(views["elevated"]().select("file", F.lit("⚠").alias("flag")), "file", "left")
    return rows(flagged, "farkost", "file", F.concat_ws(" ", "flag", "label", "plate"), time="tidpunkt")


def at_place(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == F.col("place")


def place_summary(q: Question, views: Views) -> DataFrame:
    """What is known of one place: its reports, heaviest alarms, vehicles, craft and actors."""
    first = F.broadcast(place_found(q.place or q.term or "", views).select("place"))
    claimed = views["claims"]().join(first, "place", "left_semi")
    here = claimed.select("file").distinct()
    head = claimed.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    hot = views["elevated"]()
    near = hot.join(here, "file", "left_semi").unionByName(hot.join(first, at_place("plats"), "left_semi").join(here, "file", "left_anti"))
    heaviest = near.orderBy(F.col("score").desc(), "tidpunkt", "file").limit(PLACE_ALARMS)
    plates = claimed.select(F.explode("plates").alias("canonical")).distinct()
    craft = views["craft"]().join(first, at_place("plats"), "left_semi").orderBy("tidpunkt", "file", "type").limit(PLACE_CRAFT)
    who = views["chains"]().join(first, at_place("plats"), "left_semi").select("actor").distinct()
    parts = [
        rows(head, "rapporter", "place", None, F.col("n")),
        rows(heaviest, "larm", "file", F.array_join(reason_phrases(F.col("reasons")), ", "), F.col("score"), "tidpunkt"),
        rows(views["vehicles"]().join(plates, "canonical", "left_semi"), "fordon", "canonical", None, F.col("count")),
        rows(craft, "farkost", "file", F.col("label"), time="tidpunkt"),
        rows(who, "aktör", "actor"),
    ]
    return reduce(DataFrame.unionByName, parts)


def overview(q: Question, views: Views) -> DataFrame:
    """Seven counts, the heaviest alarms, the hottest places and the latest craft that matter (AG14)."""
    threat = views["craft"]().filter("threat > 0")
    counted = {"Rapporter": views["reports"](), "Fordon": views["vehicles"](), "Kännetecken": views["nominations"](), "Aktörer": views["actors"](), "Platser": views["places"](), "Larm": views["elevated"](), "Farkoster": threat}
    parts = [rows(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("ref"), "n"), "antal", "ref", None, F.col("n")) for name, df in counted.items()]
    hot = views["elevated"]().orderBy(F.col("score").desc(), "tidpunkt", "tnr", "file").limit(TOP_ALARMS)
    spots = views["places"]().filter("elevated > 0").orderBy(F.col("elevated").desc(), F.col("reports").desc(), "place").limit(TOP_PLACES)
    late = threat.orderBy(F.col("tidpunkt").desc(), "file", "type").limit(TOP_CRAFT)
    parts += [rows(hot, "larm", "file", None, F.col("score"), "tidpunkt"), rows(spots, "plats", "place", None, F.col("elevated")), rows(late, "farkost", "file", F.col("label"), time="tidpunkt")]
    return reduce(DataFrame.unionByName, parts)


def summary(q: Question, views: Views) -> DataFrame:
    return place_summary(q, views) if q.place or (q.target == "plats" and q.term) else overview(q, views)


EXECUTORS: dict[tuple[str, str], Callable[[Question, Views], DataFrame]] = {
    ("detail", "fordon"): vehicle_detail, ("detail", "kannetecken"): mark_detail, ("detail", "aktor"): actor_detail, ("detail", "plats"): place_detail, ("detail", "farkost"): craft_seen,
    ("list", "fordon"): vehicles, ("list", "kannetecken"): marks, ("list", "aktor"): actors, ("list", "plats"): places, ("list", "larm"): alarms, ("list", "farkost"): craft_seen, ("list", "alla"): reports,
    ("timeline", "larm"): alarms, ("timeline", "farkost"): craft_seen,
}
OTHERS = {"detail": searched_or_listed, "list": reports, "timeline": observations, "summary": summary}


def answer(q: Question, views: Views) -> DataFrame:
    """Rows of a question: (part, ref, text, n, tidpunkt).

    ``views`` has reports, elevated, vehicles, observations, nominations, members, places,
    claims, actors, actor_facets, chains and craft, each built when called.
    """
    run = refusal if q.guard else EXECUTORS.get((q.shape, q.target), OTHERS[q.shape])
    if q.shape == "timeline" and run is observations:
        q = Question(q.shape, "alla", q.term, q.least, q.window, q.place, q.observer)
    return run(q, views)


def ordered(found: DataFrame, q: Question) -> DataFrame:
    """A timeline and observations by time, lists by number."""
    by_time = q.shape == "timeline" or q.target in ("alla", "farkost")
    return found.orderBy("tidpunkt", "ref") if by_time else found.orderBy(F.col("n").desc(), "ref")


def cited(text: str, answered: str) -> str:
    """An answer retold without its thinking, with the citations that the retelling lost put back at its end."""
    told = re.sub(r"(?s)<think>.*?</think>", "", text).strip()
    find = lambda s: re.findall(r"\[\[[^\]]+\]\]", s)
    lost = [c for c in dict.fromkeys(find(answered)) if c not in find(told)]
    return told + (" " + " ".join(lost) if lost else "")
