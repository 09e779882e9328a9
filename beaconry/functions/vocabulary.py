"""Fixed values that results depend on: word lists, weights, bands and limits.

Everything here is data; the logic that reads it is in the operators. Word order
matters where an operator reports the first word it finds.
"""

from __future__ import annotations

from typing import NamedTuple

# The protected object, proximity bands, thresholds.
OBJECT_LAT, OBJECT_LON = 59.2622, 17.712
OBJECT_BANDS_M = (800.0, 1600.0, 3000.0)
SENSITIVE_FACTORS = (1.0, 2.0, 4.0)
BAND_WEIGHTS = (3, 2, 1)
ELEVATED_FROM = 5
LEVELS = ((9, "Hög"), (6, "Förhöjd"), (5, "Att bevaka"))
FLAG_WEIGHT = 9
NAMELESS_WITHIN_M = 500.0
FEED_ROWS = 60
REPORT_TYPE = "7S-rapport"
GENERATOR = "7s-plugin"

# Letters of a plate, shapes of identifiers.
PLATE_LETTERS = "ABCDEFGHJKLMNPRSTUWXYZ"
PLATE = f"[{PLATE_LETTERS}]{{3}}[0-9]{{2}}[0-9{PLATE_LETTERS}]"
PLATE_LINK = f"[{PLATE_LETTERS}.]{{3}}[0-9.]{{2}}[0-9{PLATE_LETTERS}.]"
PLATE_PROSE = rf"[{PLATE_LETTERS}]{{3}}\s?[0-9]{{2}}[0-9{PLATE_LETTERS}]"
PERSON_NUMBER = r"(?:[0-9]{6}|[0-9]{8})[-+][0-9]{4}"
GRID = r"[0-9]{1,2}[C-X][A-Z]{2}\s?[0-9]{2,5}\s?[0-9]{2,5}"


class Indicator(NamedTuple):
    key: str
    label: str
    weight: int
    stems: tuple[str, ...]


def _stems(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


# Threat indicators, their weights and the stems that show them.
INDICATORS = (
    Indicator("observation", "övervakning/spaning", 2, _stems(
        "betrakta, iaktt, uppsikt mot, uppsikt över, höll uppsikt, höll utkik, höll koll, håller koll, hålla koll, håller utkik, spana, rekognos, rekade, "
        "observera, övervaka, bevakade, bevakar, glor mot, kollar mot vakt")),
    Indicator("optik", "optik/foto", 2, _stems(
        "kikare, teleobjektiv, fotografera, kamera, filmade, zoomade, drönar, nattkikare, värmekamera, mörkerkikare, kikarsikte, systemkamera")),
    Indicator("registrering", "registrering/kartläggning", 2, _stems(
        "antecknade, antecknar, block, stegräknare, kartlägg, mätte, koordinater, gps, positionerade, märkte ut, skiss, tidtog, prickade av, prickar av, "
        "räknade fordon, räknade passager, räknar fordon, räknar bilar, räknar vakter, räknar passager, noterar tider, noterar tidpunkter, stegar upp, stegar av")),
    Indicator("kontraspaning", "kontraspaning", 2, _stems(
        "kontraspaning, drog sig undan, undvek ögonkontakt, tittade bakåt, tittar bakåt, tittar över axeln, över axeln, sänkte blicken, väjde undan, gömde sig, "
        "gömmer, maskerade, vände tvärt, vänder tvärt, cirklade, bytte riktning, försvinner så fort, bryter av och")),
    Indicator("dröjande", "dröjande/upprepning", 2, _stems(
        "stod stilla länge, andra varvet, tredje varvet, långsam passage, upprepat, dröjde kvar, för tredje gången, tredje gången, kör sakta förbi, "
        "kör långsamt förbi, flera varv, runt kvarteret, ett varv till, upprepade gånger")),
    Indicator("perimeter", "närmande/rekognosering av objekt", 2, _stems(
        "kände på staketet, kände på grinden, testade grinden, testade låset, klättrade över, klättrar över, kröp, kryper, forcerade, forcerar, trängde in, "
        "tog sig in, tog sig över, rycker i handtaget, rycker i grinden")),
    Indicator("teknik", "teknisk inhämtning", 2, _stems("antenn, sändare, störsändare, avlyssning, signalspaning, pejlade, pejl")),
    Indicator("sabotage", "sabotage/åverkan", 3, _stems(
        "manipulera, bände upp, bänder upp, bröt sig in, bryter sig in, bryter loss, bryter upp, kopplade bort, kopplar bort, saboterade, saboterar, sabotage, "
        "klippte upp, klippte hål, klipper upp, klipper hål, sågade av, sågar av, dyrkade, dyrkar, bultsax, avbitartång, kofot, bågfil, sprängmedel, brytverktyg, "
        "brutit sönder")),
    Indicator("attentat", "attentatsindikator", 3, _stems(
        "oidentifierad väska, kvarlämnad, herrelöst, lämnade en väska, lämnade ett paket, obevakad väska, övergiven väska, övergiven ryggsäck, misstänkt föremål, "
        "misstänkt paket, placerade ett föremål, placerade ett paket, ställer ifrån sig en väska, ställer ifrån sig ett paket, ställer ifrån sig en ryggsäck, "
        "grävde ned, gräver ner, gräver ned, fordonsspärr, körde långsamt förbi, upprepade förbifarter, rammade")),
    Indicator("infiltration", "infiltration/tillträde", 2, _stems(
        "obehörig, utan behörighet, smet in, smiter in, gled in vid, glider in, utgav sig för, utger sig för, utger sig, påstår sig vara, säger sig vara, "
        "uppger sig, låtsades vara, falsk arbetsorder, saknade arbetsorder, saknar arbetsorder, fel firmanamn, kan inte visa legitimation, förfalskad, "
        "skuggade en, skuggade personal, skuggar, följde efter personal, följer efter, går tätt bakom, testade en dörr, testade dörren, testar dörren, "
        "testar en dörr, testar dörrhandtaget")),
)


class Craft(NamedTuple):
    key: str
    medium: str
    plated: bool
    threat: int
    cue: bool
    words: tuple[str, ...]
    stems: tuple[str, ...]


def _craft(key: str, medium: str, plated: bool, threat: int, cue: bool, words: str, stems: str = "") -> Craft:
    return Craft(key, medium, plated, threat, cue, tuple(words.split()), tuple(stems.split()))


# Kinds of craft, whether they carry a plate, their threat, and the words (whole) and stems (anywhere) that name them.
CRAFTS = (
    _craft("bil", "mark", True, 0, False, "bil bilen bilar bilarna personbil personbilen personbilar"),
    _craft("lastbil", "mark", True, 0, True, "lastbil lastbilen lastbilar skåpbil skåpbilen husbil husbilen postbil postbilen budbil budbilen transportbil flakbil tankbil pickup", "lastbil skåpbil"),
    _craft("traktor", "mark", True, 0, True, "traktor traktorn traktorer traktorerna", "traktor"),
    _craft("motorcykel", "mark", True, 0, True, "motorcykel motorcykeln motorcyklar mc moped mopeden mopeder skoter skotern fyrhjuling fyrhjulingen", "motorcyk"),
    _craft("buss", "mark", True, 0, True, "buss bussen bussar bussarna minibuss minibussen"),
    _craft("cykel", "mark", False, 0, True, "cykel cykeln cyklar cyklarna"),
    _craft("sparkcykel", "mark", False, 0, True, "sparkcykel sparkcykeln elsparkcykel elsparkcykeln elcykel elcykeln scooter"),
    _craft("kärra", "mark", False, 0, True, "kärra kärran kärror dragkärra skottkärra släpkärra"),
    _craft("båt", "vatten", False, 1, True, "båt båten båtar båtarna motorbåt motorbåten segelbåt segelbåten fritidsbåt fritidsbåten roddbåt gummibåt jolle jollen kajak kajaken ribbåt snabbåt vattenskoter", "båt"),
    _craft("fartyg", "vatten", False, 1, True, "fartyg fartyget skepp skeppet tankfartyg lastfartyg örlogsfartyg", "fartyg"),
    _craft("färja", "vatten", False, 0, True, "färja färjan färjor bilfärja passagerarfärja vägfärja", "färja"),
    _craft("drönare", "luft", False, 3, True, "drönare drönaren drönarna quadcopter kvadkopter multirotor", "drönar"),
    _craft("helikopter", "luft", False, 2, True, "helikopter helikoptern helikoptrar chopper", "helikopt"),
    _craft("flygplan", "luft", False, 1, True, "flygplan flygplanet sjöflygplan propellerplan segelflygplan ultralätt", "flygplan"),
)

# Vocabularies of distinctive marks. Order is the order of search.
MARK_OBJECTS = (
    ("ryggsäck", "ryggsack"), ("väska", "ryggsack"), ("keps", "huvudbonad"), ("mössa", "huvudbonad"), ("huvudbonad", "huvudbonad"), ("kikare", "optik"), ("kamera", "optik"),
    ("optik", "optik"), ("långt objektiv", "optik"), ("teleobjektiv", "optik"), ("nattkikare", "optik"), ("mörkerkikare", "optik"), ("värmekamera", "optik"), ("drönar", "optik"),
)
OPTIC_TYPES = (
    ("teleobjektiv", "teleobjektiv"), ("långt objektiv", "teleobjektiv"), ("nattkikare", "nattkikare"), ("mörkerkikare", "nattkikare"), ("värmekamera", "värmekamera"), ("drönar", "drönare"),
)
RARE_ITEMS = (
    ("bultsax", "verktyg", "bultsax"), ("avbitartång", "verktyg", "bultsax"), ("kofot", "verktyg", "kofot"), ("bräckjärn", "verktyg", "kofot"), ("kobräck", "verktyg", "kofot"),
    ("bågfil", "verktyg", "bågfil"), ("brytverktyg", "verktyg", "brytverktyg"), ("antenn", "teknik", "antenn"), ("riktantenn", "teknik", "antenn"),
    ("störsändare", "teknik", "sändare"), ("sändare", "teknik", "sändare"), ("pejlutrustning", "teknik", "pejl"),
)
MARKINGS = ("märke", "emblem", "tryck", "symbol", "logga", "logotyp", "dekalrest", "dekal", "klistermärke", "text")
MARK_COLOURS = (
    ("svart", "mörk"), ("mörk", "mörk"), ("mörkt", "mörk"), ("mörka", "mörk"), ("mörkgrå", "mörk"), ("mörkblå", "mörk"), ("mörkröd", "mörk"), ("mörkgrön", "mörk"),
    ("ljus", "ljus"), ("ljust", "ljus"), ("ljusa", "ljus"),
)
UNCLEAR = ("delvis synlig", "delvis synligt", "delvis läsbar", "svårt att läsa", "svårläst", "otydlig", "otydligt", "delvis")
REAR = ("bakrutan", "bakglaset", "baktill")
GENERIC = (
    "inga särskilda kännetecken", "vardaglig klädsel", "neutral klädsel", "diskret klädd", "arbetskläder", "varselväst", "joggingkläder", "träningskläder", "motionskläder", "jacka",
    "kostym", "kavaj", "solglasögon", "medelålders", "vältränad", "atletisk", "kraftig", "fåordig", "samordnade rörelser", "ungdom", "cyklist", "motionär", "joggare", "hundrastare",
    "hund", "koppel", "barnvagn", "rullator", "rollator", "käpp", "ensam", "picknick", "fika",
)
NEGATIONS = ("inga", "ingen", "inget", "utan", "saknar", "avsaknad", "ej")
SEEN_BEFORE = ("samma", "som igår", "tidigare sedd", "som ovan", "igen", "återigen", "känns igen")
SIGNATURE_DIMS = {
    "ryggsack": ("farg", "marking"), "huvudbonad": ("farg", "marking"), "fordon-dekal": ("position", "marking"), "optik": ("typ",), "verktyg": ("item",), "teknik": ("item",),
}
MARK_NOUNS = {"ryggsack": "ryggsäck", "huvudbonad": "keps/mössa", "fordon-dekal": "fordonsdekal", "optik": "optik", "verktyg": "verktyg", "teknik": "teknik"}

# Words left out of the key of a mark read from free text.
KEY_STOP_WORDS = ("en", "ett", "den", "det", "med", "och", "i", "på", "av")

# Phrases for reasons shown to people.
REASON_PHRASES = {
    "proximity": "nära objektet", "natt": "nattetid", "skymning": "skymning/gryning", "beteende:observation": "övervakande beteende", "beteende:optik": "kamera/kikare",
    "beteende:registrering": "antecknande/mätande", "beteende:kontraspaning": "kontraspaningsbeteende", "beteende:dröjande": "dröjande/upprepad närvaro",
    "beteende:perimeter": "närmande mot objektet", "beteende:teknik": "teknisk avlyssning/spaning", "beteende:sabotage": "sabotage/åverkan",
    "beteende:attentat": "misstänkt föremål/fordonshot", "beteende:infiltration": "obehörigt tillträde", "återkomst": "återkommande",
}

# Equipment in pictures and the behaviour it shows: words to look for, behaviour, what it is called, weight.
PICTURE_BEHAVIOURS = (
    (("kikare", "binokl", "binocular", "tub", "sikte"), "optik", "kikare/optik", 2),
    (("kamera", "camera", "teleobjektiv", "objektiv", "telephoto", "telelins"), "optik", "kamera/teleobjektiv", 2),
    (("mät", "measur", "tumstock", "avstånds", "gps-", "kartl"), "registrering", "mätande/registrering", 2),
    (("antecknar", "anteckn", "noter", "skiss", "ritblock"), "registrering", "antecknande", 2),
    (("observ", "spanar", "betraktar", "övervakar", "watching"), "observation", "observerande", 1),
)
