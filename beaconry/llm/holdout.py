"""Texts of known shape, in three sets that share no text, sentence, line or maker.

STAND_IN joins the training sample, for what a corpus has no sure example of; its
structured texts are made by the rules at the end. HOLDOUT calibrates the
probabilities of ``quality``, TRIAL only tests them: both are written by hand, and
each text's shape was judged by reading it. None comes from any corpus.
"""

from __future__ import annotations

import random

# The words STAND_IN is made of.
THINGS = "lastpall, grön presenning, TLB402, skrivbordet i hallen, ekstubbe, reservdäck 3, mätlåda, gul stege, bakre grinden, Norrtorp, KXM71A, vedtrave".split(", ")
NAMES = "Västerby, Granhult, Torsmåla, Björklanda, Skogslid, Mosshult, Rävanäs, Lindkulla".split(", ")
LABELS = "färg, märke, ort, sort, nummer, ägare".split(", ")
BUTTONS = "Meny, Sök, Logga in, Dela, OK, Avbryt, Visa mer…, Nästa »".split(", ")

TAUGHT = [
    "Patrullen stannade vid kvarnen och lyssnade en stund, men det enda som hördes var vattnet. Efter en halvtimme fortsatte de mot kyrkan.",
    "Det gick inte att avgöra om mannen hade något i handen, för han stod med ryggen mot oss. När lampan tändes var han redan borta.",
    "The guard said that the gate had been open all night and that somebody must have forgotten to close it. We wrote down the time and went on.",
    "They were seen by two of our drivers, who had stopped because of the snow. Neither of them could say which way the van went after that.",
    "Vi snakket med en fisker som mente at båten hadde ligget der siden lørdag, men han var ikke sikker på om det var den samme.",
    "Am Abend kam der Wagen noch einmal zurück, und diesmal blieb er vor dem Tor stehen. Wer am Steuer saß, konnte keiner von uns sehen.",
    "Mies kertoi, että hän oli nähnyt saman auton kahdesti viikon aikana, mutta hän ei muistanut, mitä kilvessä oli.",
    "På söndagen var det fler människor än vanligt på stigen, och därför är det svårt att säga vilka som hörde till orten. En av dem frågade efter vägen till sjön.",
]

# The texts that calibrate.
PROSE = [
    "Vakten gick ett varv runt huset strax efter midnatt och hörde ingenting. På vägen tillbaka mötte hon en man som sa att han letade efter sin hund.",
    "Det är inte säkert att bilen som stod vid bron är samma bil som sågs dagen före, men färgen stämmer. Vi bad grannen att ringa om den kommer tillbaka.",
    "The crew waited by the harbour until the rain had stopped. Nobody came, and the boat that had been reported was not there in the morning.",
    "Nous ne savons pas: the notes of the second day say that a woman walked slowly past the gate, and that she did not look at the building at all.",
    "Vi ba naboen om å følge med på porten, fordi en ukjent bil hadde stått der to dager på rad. Ingen har sett den etter regnet.",
    "Es ist nicht sicher, ob der Fahrer derselbe ist wie am Vortag. Bei der Brücke wurden drei Wagen gezählt, aber das Licht war zu schlecht.",
    "Ei ole varmaa, oliko kulkija sama henkilö. Naapuri kertoo, että auto odotti portilla pitkään ja että kilpi oli kurassa.",
    "ENLIGT PATRULLEN VAR DET LUGNT UNDER NATTEN OCH INGEN BIL STOD KVAR VID GRINDEN. EN MAN SOM GICK FÖRBI SA ATT HAN BODDE I HUSET.",
    "# Hallinge\n\nUnder kvällen såg vi hur två personer bar en låda till en båt. De var inte där när vi kom tillbaka, och ingen hade sett dem tidigare.",
    "---\ntyp: not\ntnr: \"100200\"\n---\n\nEn kvinna med cykel stannade vid skylten och skrev något i en bok. Hon var kvar i tio minuter och åkte sedan mot byn.",
    "**TNR:** 400500\n\n**Ställe:** Ekeröd\n\n**Händelse:** Efter en timme kom mannen tillbaka och ställde en väska vid dörren, men han gick innan vi hann fram till honom.",
    "en äldre man stod vid vägen och tittade mot masten utan att göra något annat och när vi frågade sa han att han väntade på en vän som var sen",
    "Vi tog med oss följande till posten, eftersom vädret var dåligt och natten skulle bli lång:\n- filt\n- lampa\n- mat\nDet räckte gott och väl, och på morgonen var allt kvar som vi hade lämnat det.",
    "Vid den gamla stationen noterades 14 fordon under kvällen, varav ett stod kvar i 40 minuter innan det åkte.",
    "pÃ¥ vÃ¤gen till sjÃ¶n mÃ¶tte vi en man som inte ville sÃ¤ga vad han hette och som sedan gick in i skogen",
]


LISTS = [
    "- ficklampa\n- rep, tio meter\n- kniv\n- två dunkar vatten\n- karta över området\n- reservbatterier",
    "* Anna, köket\n* Per, porten\n* Lotta, förrådet\n* Olle, bilen\n* Siv, telefonen",
    "1. låsa dörren\n2. släcka lampan\n3. ställa ut skylten\n4. ringa vakten\n5. skriva i boken\n6. byta vatten",
    "a) cyklar\nb) mopeder\nc) släpkärror\nd) traktorer\ne) bussar",
    "Fabrikat: okänt\nKulör: vinröd\nDörrar: fem\nDäck: dubbade\nSkylt: saknas\nLast: ved\nFörare: en man",
    "Namn: Lisa\nTelefon: 0700\nPost: nej\nTjänst: natt\nBil: egen",
    "hammare, såg, spik, skruv, vattenpass, tumstock, borr, fil, tång, yxa, spett, kil, planka",
    "Sala; Heby; Tärnsjö; Östervåla; Harbo; Björklinge; Vattholma; Skyttorp; Örbyhus",
    "[x] dieseln kontrollerad\n[ ] oljan bytt\n[x] lyktor rena\n[ ] däcktryck\n[ ] torkarblad\n[x] varningstriangel",
    "• red car by the fence\n• blue van, no plates\n• old bicycle\n• trailer with planks\n• two scooters",
    "Packning inför torsdag\n\n– stövlar\n– regnställ\n– termos\n– kikare\n– block och penna\n– varma vantar\n– smörgåsar\n– sittunderlag",
]

TABLES = [
    "plats\tantal\tklockan\nbron\t4\t07.10\nkajen\t2\t07.25\nslussen\t9\t07.40\nmagasinet\t1\t08.05",
    "datum;fordon;anmärkning\n3 maj;buss;sen\n4 maj;buss;inställd\n5 maj;tåg;i tid\n6 maj;färja;full",
    "| vakt | post | pass |\n|---|---|---|\n| Berg | norra | dag |\n| Ek | södra | kväll |\n| Alm | västra | helg |",
    "ID        NIVÅ      STATUS\n17        hög       öppen\n18        låg       stängd\n19        mellan    öppen\n20        hög       stängd",
    "12.4   88.1   0.7\n13.0   87.5   0.9\n11.8   90.2   0.4\n12.9   86.6   1.1\n13.3   85.0   1.3",
    "<table><tr><th>dag</th><th>regn</th></tr><tr><td>mån</td><td>3 mm</td></tr><tr><td>tis</td><td>0 mm</td></tr><tr><td>ons</td><td>11 mm</td></tr></table>",
    "sector | vehicles | people\nA | 3 | 5\nB | 0 | 2\nC | 7 | 7\nD | 1 | 4",
    "Resultatet per lag:\n\nlag\tmål\tpoäng\nröda\t5\t9\nblå\t3\t6\ngula\t1\t2\ngröna\t0\t0",
]

JUNK = [
    "%%¤¤## @@!! ]]}} ^^~~ ||\\\\ //** ++== ??!! ;;:: <<>> ##%% &&@@ **^^ ~~|| ==++ {{[[ ))((",
    "bm9pc2Ugb25seSBub3RoaW5nIHRvIHJlYWQgaGVyZSBhdCBhbGwgc29ycnkgZm9yIHRoYXQ0NzExWlhZUQ==bm8gbW9yZSBub2lzZQ==",
    "7f3a09c1 be44d2f0 0019aa73 c0ffee12 deadbe3f 91827364 aa00bb11 5e6f7a8b 3c2d1e0f 77aa66bb",
    "xqzt vbrk plmw gfdj zzkq wrtp hgnb mklj xcvb trwq pldk nbvc zxkj qwrt hjkl vbnm",
    "test test test test test test test test test test test test test test test test test test test test test",
    "väntar på svar väntar på svar väntar på svar väntar på svar väntar på svar väntar på svar väntar på svar väntar på svar",
    "NULL NULL undefined NULL NaN NULL undefined NULL NaN NULL NULL undefined NaN NULL undefined NULL",
    "Hem\nKontakt\nSpara\nSkriv ut\nTillbaka\nHjälp\nLogga ut\nKommentarer\nFölj",
    "Home | Login | Search | Cookies | Accept | Subscribe | Share | Help | Next | Previous | Close",
    "Â¤Ã¢â‚¬Å“Ã¢Ã¢â€šÂ¬ÂÃƒÂ¢Ã‚Â€Ã‚Â¦ÃƒÂ¥ÃƒÂ¤ÃƒÂ¶ÃƒÅ¸ÃƒÂ¼Ã‚Â´Ã‚Â¨ÃƒÂ±Ã‚Â§Ã‚Â½Ã‚Â¿",
]

# The texts that only test.
TRIAL_PROSE = [
    "Under förmiddagen kom en lastbil och ställde sig vid lastkajen. Föraren klev ur, rökte en cigarett och körde sedan därifrån utan att ha lastat av något.",
    "Ingen av oss hade sett honom förut. Han talade länge med mannen i kiosken, köpte en tidning och gick tillbaka samma väg som han hade kommit.",
    "We could not get closer than the old barn, because the dogs began to bark. From there it was hard to see who was in the car.",
    "Kvinnen ved brygga sa at hun hadde hørt en motor i natt, men at hun ikke ville gå ut og se etter.",
    "Die Tür war nicht abgeschlossen, als wir kamen, und auf dem Boden lag noch Glas. Der Nachbar sagte, dass er nichts gehört habe.",
    "Ilmoituksen mukaan vene oli rannassa vielä aamulla, mutta kun me tulimme paikalle, se oli jo lähtenyt eikä ketään ollut näkyvissä.",
    "JAG STOD KVAR TILLS DET BLEV MÖRKT MEN SÅG INGEN SOM KOM ELLER GICK. DÖRREN VAR STÄNGD HELA TIDEN OCH DET LYSTE INTE I FÖNSTREN.",
    "## Anteckning\n\nDet blåste hårt och därför gick vi in i skjulet en stund. När vi kom ut igen hade spåren redan snöat igen.",
    "hon sa att bilen brukar stå där på kvällarna och att den som kör den alltid har keps och aldrig hälsar på någon",
]
TRIAL_LISTS = [
    "- båtshake\n- livväst\n- ankare\n- åror\n- öskar\n- tamp",
    "1) skruva loss plåten\n2) torka ytan\n3) limma\n4) pressa\n5) vänta\n6) slipa",
    "Höjd: 180\nHår: mörkt\nJacka: blå\nSkor: vita\nVäska: nej\nÅlder: trettio",
    "ek, björk, asp, al, gran, tall, lönn, lind, rönn, hägg, sälg, bok, alm",
    "* grey truck\n* white trailer\n* tool box\n* ladder\n* rope\n* spare wheel",
]
TRIAL_TABLES = [
    "kl\tvind\tsikt\n06\t4\tgod\n09\t7\tmåttlig\n12\t11\tdålig\n15\t9\tmåttlig",
    "kod;typ;antal\nR1;kran;2\nR2;truck;5\nR3;vagn;14\nR4;pump;1",
    "| station | avgång | spår |\n|---|---|---|\n| Norra | 08:12 | 2 |\n| Centrum | 08:31 | 5 |\n| Hamnen | 08:50 | 1 |",
    "BANA     TID      FEL\n1        58,2     0\n2        61,7     2\n3        59,9     1\n4        64,0     3",
]
TRIAL_JUNK = [
    "]]>> ~~## $$%% ^^&& **(( )){{ }}|| \\\\:: ;;'' ,,.. //?? ``~~ !!@@ ##$$ %%^^",
    "U2x1bXAgb2NoIGluZ2V0IGFubmF0IGjDpHIgYmFyYSBiZXRlY2tlbg1234567890abcdefABCDEFzzTopQQ==",
    "0x1f 0x2e 0x3d 0x4c 0x5b 0x6a 0x79 0x88 0x97 0xa6 0xb5 0xc4 0xd3 0xe2 0xf1",
    "ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja ja",
    "About\nReply\nFollow\nEdit\nRead more\nPrint\nSign out\nCancel\nContact",
]


# The rules STAND_IN's structured texts are made by.
def _items(pick: random.Random, n: int) -> list[str]:
    return [pick.choice(THINGS + NAMES) for _ in range(n)]


def _lists(pick: random.Random) -> list[str]:
    marks = ["- ", "* ", "• ", "– ", "[ ] "]
    texts = ["\n".join(mark + x for x in _items(pick, pick.randint(5, 20))) for mark in marks]
    texts.append("\n".join(f"{i}{pick.choice('.)')} {x}" for i, x in enumerate(_items(pick, 9), 1)))
    texts.append("\n".join(f"{pick.choice(LABELS)}: {x}" for x in _items(pick, 8)))
    texts += [", ".join(_items(pick, 14)), "; ".join(_items(pick, 11))]
    texts.append("Det här tog vi med från förrådet.\n" + "\n".join("- " + x for x in _items(pick, 16)))
    return texts


def _tables(pick: random.Random) -> list[str]:
    rows = [["tid", "namn", "antal"]] + [[f"{pick.randint(0, 23):02}:{pick.randint(0, 59):02}", pick.choice(NAMES), str(pick.randint(1, 60))] for _ in range(pick.randint(6, 18))]
    joined = lambda mark, part: "\n".join(mark.join(r) for r in part)
    return [
        joined("\t", rows),
        joined(";", rows),
        joined(";", rows[1:]),
        "\n".join("| " + " | ".join(r) + " |" for r in rows[:1] + [["---"] * 3] + rows[1:]),
        "\n".join("".join(c.ljust(14) for c in r) for r in rows),
        "\n".join("".join(c.ljust(12) for c in r) for r in rows[1:]),
        "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>",
        "Så här såg det ut den dagen.\n\n" + joined("\t", rows),
    ]


def _junk(pick: random.Random) -> list[str]:
    of = lambda signs, n: "".join(pick.choice(signs) for _ in range(n))
    return [
        of("#$%&/()=?{}[]<>|~^*_-:;. ", 300),
        of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 400),
        " ".join(of("0123456789abcdef", 8) for _ in range(40)),
        " ".join(of("qwhjklsdfaeöw", pick.randint(2, 10)) for _ in range(60)),
        "logg " * 70,
        "inte klart " * 40,
        "ERROR 0x0 " * 30,
        "\n".join(pick.choice(BUTTONS) for _ in range(30)),
        "\n".join(BUTTONS),
        of("ÃÂïÑÐœŒƒ€¢¤¥¶½¿Ã", 260),
    ]


def _texts(seed: int) -> list[tuple[str, str]]:
    pick = random.Random(seed)
    built = {"list": _lists(pick), "table": _tables(pick), "junk": _junk(pick)}
    return [(text, shape) for shape, texts in built.items() for text in texts]


def _set(prose: list[str], lists: list[str], tables: list[str], junk: list[str]) -> list[tuple[str, str]]:
    return [(t, shape) for shape, texts in (("prose", prose), ("list", lists), ("table", tables), ("junk", junk)) for t in texts]


STAND_IN: list[tuple[str, str]] = [(f"{a} {b}", "prose") for a in TAUGHT for b in TAUGHT if a != b] + [x for seed in (21, 22, 23, 24, 25) for x in _texts(seed)]
HOLDOUT = _set(PROSE, LISTS, TABLES, JUNK)
TRIAL = _set(TRIAL_PROSE, TRIAL_LISTS, TRIAL_TABLES, TRIAL_JUNK)
