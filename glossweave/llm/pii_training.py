"""Generated sentences with labelled personal information, from which the random field learns its weights.

All names, numbers and places are made up from syllables. What stands before and after them is put together
from everyday phrases in English, German, French and Spanish, as are look-alikes that are none; no sentence of
the corpora was taken.
"""

from __future__ import annotations

import random
import re

from glossweave.llm.pii import FIRST_NAMES

_ONSET = "b br d dr f fl g gr h j k kl l m n p pr r s st t tr v w z".split()
_VOWEL = "a e i o u ei ö ü é ø".split()
_CODA = "l m n nd r rs s sk t th v x".split()
_TAIL = "berg son sen ini ez ov ova man dal vik well er ard ong elli etti ieux ault ier".split()

#: Parts from which sentences are put together at random: what may stand before a value of a type, and after it.
_BEFORE = {
    "name": """Author: |Written by |Prepared by |Reviewed by |Approved by |Investigator: |Head of the unit: |Principal investigator: |Regards, |Yours sincerely, |Best, \\n|Many thanks,\\n|Greetings from |
        Thanks go to |We are indebted to |with help from |The idea came from |Questions? Ask |please ask |Please address queries to |interviewed by |as told by |as |and |said |notes by |(courtesy of |(unpublished data of |
        Dr. |Prof. |Dr |Professor |Mr. |Mrs. |Ms |Frau |Herr |Señora |Señor |Mme |Verfasser: |Verantwortlich: |Leitung: |Es dankt |nach Angaben von |im Namen von |laut |
        Responsable: |Contacto: |Firmado por |según |agradecemos a |la sangre de |los datos de |el suero de |la orina de |el nombre de |la firma de |la voz de |les notes de |Auteur : |Rédigé par |d'après |selon |le dossier de |l'échantillon de |Befund von |Blutbild von |
        The donor, |The volunteer |The child |Name: |Surname and name: |Patient's name: |Proband: |Donor: |Case 4: |Participant |Next of kin: |The nurse |Guardian: |Sister of the patient: |Uncle of the index case: |Spouse: |Signed |""",
    "email": """E-mail: |e-mail |Email |mail to |Mail: |or by mail at |reach us at |please use |send files to |send a note to |Address mail to |contact |Contact: |code: |files: |Questions: |queries to |available via |on demand from |
        Courriel : |Correo: |escriba a |écrire à |Anfragen an |bitte an |<|(|[|; |, |\\n|* |- |or |und |y |et |""",
    "phone": """Phone: |phone |Phone |Tel: |Tel |T: |Telephone |Fax |Mobile: |Cell |ring |dial |calls to |call us on |call |Call |or |on |at |under |hotline |Hotline: |Telefon: |Telefon |Tel.: |Tel. |Tél. : |Tél. |tél. |
        Teléfono: |Teléfono |llame al |appeler le |Rückruf unter |erreichbar unter |Durchwahl |by phone (|(phone |; |, |\\n|* |""",
    "address": """Address: |Home address: |Postal address: |lives at |lived at |resident at |living at |at |of |from |to |sent to |posted to |delivered to |visited at |Office: |our office, |The practice moved to |wohnhaft |wohnt in der |Anschrift: |Wohnort: |
        Adresse : |domicilié au |demeurant au |habite au |Dirección: |vive en |domiciliada en |residente en |entregado en |, |; |\\n|(|""",
    "id": """{cue} |{cue}: |{cue} |{cue} is |{cue}, |({cue} |({cue}: |, {cue} |with {cue} |has {cue} |under {cue} |gave {cue} |{cue} number |no. |number |labelled |the person behind |the holder of |holds |linked to |stands for |replaced |under |by |""",
}
_AFTER = {
    "name": """.|.|,| |;|)|) | wrote the first draft.| kept the records.| read all slides.| did the imaging.| ran the assays.| collected saliva.| joined late.| signed the form.| agreed to be named.| was seen twice.| was born at term.| and colleagues| and others went home.| and the nurse came.| and | (| (female, 44)|, who |, aged 61,| et al.| hat alles geprüft.| war dabei.| a signé.| tomó la muestra.| llegó antes.| est venu.| came to the ward.|\\n|\\n""",
    "email": """.|.|;|,|)|)|>|]| for the code.| for details.| if needed.| (monitored daily).|\\n| or |, subject "data".""",
    "phone": """.|.|;|,|)|) | after nine.| between 8 and 16 h.| (mornings).| (ward desk).|\\n| or | if late.| for an appointment.| in an emergency.| before coming.""",
    "address": """.|.|,|;|)| by post.| until spring.| on that day.| with the parents.| in a cold box.|, by noon.|, second floor.|\\n|: """,
    "id": """.|.|,|;|)|) |) is missing.| is on file.| was removed.| was copied.| was read out.| to the sample.| to bag 7.|\\n|: """,
}
_PLAIN_TEXT = "the samples were kept cold|no change was seen|see the notes|data were lost|all agreed|die Proben blieben kalt|keine Änderung|rien n'a changé|les données manquent|sin cambios|los datos faltan|the rest is unknown|more follows|as planned|in spring".split("|")

_DECOYS = """
Grant {y}-{d4}-{d2} paid for this.|Order {L2}-{d3}-{d4} arrived late.|Lot {d2}-{d4}-{d2} and sequence {L3}{d7} were checked.|the window {d8}-{d8} on arm {d1}|{d3} {d3} and {d2} {d3} objects in each view, release {d2}.{d1}.0.{d1}.|Deposited as {L2}{d6}, {L3}{d7} and {L1}{d5}.
Tray {d2}, line C: {d5} spots; entry {d8} failed.|Oligos {L3}GGACCATT, exon {d1}, box {L2}-{d6}.|ethics vote {d4}/{d2}.|The {T} Hospital and {T} College gave ethics vote {d4}/{d2}.|The {T} Institute of {T} and the {T} Foundation|Department of {T} {T}, {T} University|{T} General Clinic, {T} Center
The {T} sign was absent.|{T} disease and {T} syndrome|the {T} test|in {T} medium|{T}'s method, the {T} {T} score and the {T} {T} equation|A {T} {T} plot|{T}-{T} fever|Accounts like @{t} and {t}@ stay.|beads@{t} at {d1}:{d3}|A {T}@{t} mix of {d3} was used.
Die {T} hemmen {T}, so dass {T} und {T} sinken.|Ob {T} auch {T} bindet, zeigt {T} mit {L3}{d2}.|Mit {T} und {L3}{d2} stieg die {T}.|In {d2} Fällen trat {T} neben {T} auf.|Les {t} portent {T} et {L3}{d2}.|Con {T} subió la {t}.|¿Por qué {T} y {T} suben la {t}?|Ohne {T} sank {T} um {d2} %.|Wegen {T} fiel {T}.|{T} und {T} wirken.|{T} et {T} agissent|{T} y {T} suben
Why {T} needs {L3}-{d1} {t} in {t} depends on {t} and {T}.|Neither {T} nor {L3}{d2} binds {t}.|The {T} {t} holds {t}; {L3}{d2} lets go.|{T} {T} Shows An {T} {T} In {d3} Min Of {T} With {T}.|{T} {T} Of {T} {T} In {T} {T}.|With {T} {T}, {T} {T} Rises.|{T} {T} {T} And {T} {T}, A {T} Study.|{T} And {T} Are {T} In {T}.|An {T} View Of {T} {T}
DATA ON {U} {U} ARE {U}.|{U} {U} OR {U} ROSE|{U} {U} AND {U} {U} DO {U} TO {U}|THE {U} OF {U} {U}|{U} IS {U} BY {U} {U}. NO {U}|Aim: {T} {t} {t} in {d3} h.|Results: {T} {T} fell.|Decay of {L3}{d2} ({d2}.{d1} nM; N = {d2}) fits {t}.|build {d1}.{d1}.{d2}, key {d6}.|We had {d3} {d3} cells at {d2} °C.|labels ({T} or {T}) {t} {d3} s
From {T} Labs came {L2}{d6}.|Rack {d2}, drawer {d1}, tube {d4}.|since {y}, {d5} cases and {d4} others|ISBN 978-{d1}-{d4}-{d4}-{d1}|doi 10.{d4}/{t}.{y}.{d6}|Bill {d6} dated {d2}.{d2}.{y}|cf. Suppl. Fig. {d1}|{T}, {T} and {L3}{d2} make a {t} {t} which {t}.|{T}, {L3}-{d1} and {T} make {t}.|{T}, {T} und {T} formen {T}.|{L3}{d2}, {T} and {T} make a {t}.
{T} And {T} {T} Help {T}.|{T} and {T} {t} alike.|{T} or {T} {t} more.|{T} {T} {T} In {d3} H, By {T} {T}. Oddly, {T} {T}|A {T} {T} Is {T} For {T} {T} And {T} {T}.|{T} Without {T} Held {T}-{T} {T} In {d2} % Of {T}.|{d2} % From {T}-{T} {T}. In {T} {T}, The {L2}{d1} {T}|This Links {T} To {T}-{T} {T} And {T}|the {T} vesicle and the {T} {t} moved|kept at {d3} to {d3} K|{U} {U} AND {U} {U} FELL {U} {U}.|{L3}{d1}, {L3}{d2}{L1} AND {U} {U} A {U} {U} THAT {U}|{U} AND {U} {U}, CF. {U} {d1}, {U} {U}|{U} {U} BY {d2} % WHEN {U} AND {U} {U} WAS {U}|So {T} Than {T} {T} Over {T} And {T}-{T} {T}. {T} {T}|{T} {T} By {d2}.{d1} As Long As {T} {T} Was {T} From {T}|By {T}-{T} {T}, {T} {T} {T} To {T}|{t} {t} and {T}, {T} and {L2}-{d1} make a {t}|{T}, {T} and {L2}{d2}{L1} {t} {t}|{T} {t} {T} {t}, {L3}{d2} {t} {T}.|{t} {T}, {t} {T}; {t} {L3}-{d1}
""".strip().split("\n")


def _word(r: random.Random) -> str:
    return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + (r.choice(_CODA) if r.random() < 0.5 else "") for _ in range(r.choice((1, 2, 2))))


def _cap(s: str) -> str:
    return s[0].upper() + s[1:]


def _surname(r: random.Random) -> str:
    return _cap(_word(r) + (r.choice(_TAIL) if r.random() < 0.6 else ""))


_ACCENTED = {"bjorn": "björn", "zoe": "zoë", "emile": "émile", "lucia": "lucía", "jose": "josé", "cecile": "cécile", "francois": "françois"}


def _name(r: random.Random) -> str:
    first = r.choice(_GIVEN) if r.random() < 0.75 else _word(r)
    first, last = _cap(_ACCENTED.get(first, first)), _surname(r)
    if r.random() < 0.12:
        last += "-" + _surname(r)
    if r.random() < 0.12:
        last = r.choice(("van ", "von ", "de ", "del ")) + last
    form = r.random()
    if form < 0.12:
        # in a list by surname, a Romance particle goes to the end
        return f"{last.removeprefix('del ').removeprefix('de ')}, {first}"
    if form < 0.3:
        return f"{first[0]}. {last}"
    if form < 0.4:
        return f"{first} {r.choice('ABCDEFGHIJKLMNOPRSTVZ')}. {last}"
    return f"{first} {last}".upper() if form < 0.5 else f"{first} {last}"


_GIVEN = sorted(FIRST_NAMES)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> str:
    plain = lambda: re.sub(r"[^a-z]", "e", _word(r))
    local = r.choice(("{a}.{b}", "{a}{n}", "{b}_{c}", "{b}-lab", "{a}.{b}+trial", "{i}{b}")).format(a=plain(), b=plain(), n=_digits(r, 2), c=plain()[:2], i=plain()[0])
    host = r.choice(("{a}-{b}", "{a}", "mail.{a}-{b}", "ext.{a}")).format(a=plain(), b=plain())
    tld = r.choice(("example", "example.org", "example.com", "test", "invalid", "org", "edu", "de", "fr", "co.uk"))
    at = r.choice(("@", "@", "@", " @ ", " [at] ", " (at) "))
    whole = f"{host}.{tld}"
    if "at]" in at and r.random() < 0.8:
        whole = whole.replace("." + tld, " [dot] " + tld)
    out = local + at + whole
    return out.upper() if r.random() < 0.1 else out


def _phone(r: random.Random) -> str:
    shape = r.choice(
        "+1 999 999 9999|+19999999999|(999) 999-9999|999-999-9999|999.999.9999|+44 20 9999 9999|020 9999 9999|0044 9999 999999|+33 1 99 99 99 99|01.99.99.99.99|01 99 99 99 99|+49 30 99999 999|030/99999-999|+34 999 999 999|0999 9999999|+49 (0)30 999999".split("|")
    )
    return "".join(r.choice("0123456789") if c == "9" else c for c in shape)


_IDS = [
    (("SSN", "social security number", "social security no.", "Sozialversicherungsnummer"), ("999-99-9999", "999999999")),
    (("tax ID", "Steuer-ID", "tax number", "numéro fiscal"), ("99 999 999 999", "99999999999")),
    (("NI number", "national insurance no.", "national insurance number"), ("AA 99 99 99 A", "AA999999A")),
    (("passport", "passport no.", "Reisepass", "passeport", "pasaporte"), ("AA9999999", "A99999999")),
    (("DNI", "identity card", "ID card no.", "carte d'identité"), ("99999999A",)),
    (("chart", "hospital record", "record no.", "medical record number"), ("MRN-99999999", "MRN 9999999", "MRN-999999")),
]


def _id(r: random.Random) -> tuple[str, str]:
    cues, shapes = r.choice(_IDS)
    return r.choice(cues), "".join(r.choice("0123456789") if c == "9" else r.choice("ABCDKLMQXZ") if c == "A" else c for c in r.choice(shapes))


def _address(r: random.Random) -> str:
    street, town, post, n = _cap(_word(r)), _cap(_word(r) + r.choice(("ton", "furt", "heim", "ville", "mouth", ""))), _digits(r, 5), r.randint(1, 250)
    if r.random() < 0.15:
        town = r.choice(("Sainte-", "Bad-", "San-")) + town
    form = r.randrange(6)
    if form == 0:
        gap = r.choice((", ", ", ", "\n"))
        return f"{n} {street} {r.choice(('Street', 'Road', 'Ave.', 'St', 'Terrace', 'Lane'))}{gap}{town} {post}"
    if form == 1:
        return f"Flat {r.randint(1, 30)}, {n} {street} {r.choice(('Close', 'Court', 'Road', 'Gardens'))}, {town}"
    if form == 2:
        return f"{street}{r.choice(('straße', 'weg', 'platz', 'allee'))} {n}{r.choice(('', '', 'b', 'a'))}, {post} {town}"
    if form == 3:
        return f"Calle {street} {n}, {r.randint(1, 9)} {r.choice('ABCD')}, {post} {town}"
    if form == 4:
        return f"{n}{r.choice(('', ' bis', ' ter'))}, {r.choice(('rue', 'avenue', 'boulevard'))} {street}, {post} {town}"
    return f"{n} {street} {r.choice(('Road', 'Terrace', 'Street', 'Drive'))}\n{town} {post}"


def _fill_decoy(r: random.Random, frame: str) -> str:
    def one(m: re.Match) -> str:
        k = m[1]
        if k[0] == "d":
            return _digits(r, int(k[1:]))
        if k[0] == "L":
            return "".join(r.choice("ABCDFGHKLNRSTVXZ") for _ in range(int(k[1:])))
        return {"y": lambda: str(r.randint(1990, 2025)), "T": lambda: _cap(_word(r)), "t": lambda: _word(r), "U": lambda: _word(r).upper()}[k]()

    return re.sub(r"\{(\w+)\}", one, frame)


def _choices(parts: str) -> list[str]:
    return [x.lstrip("\n ") if x.startswith("\n ") else x for x in parts.replace("\\n", "\r").split("|")]


def sentences(n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``n`` texts of a few sentences each with the spans in them.

    A sentence strings one to four values together, each between what may stand before and after its type.
    """
    r, out = random.Random(seed), []
    before, after = ({k: [x.replace("\r", "\n") for x in _choices(v)] for k, v in parts.items()} for parts in (_BEFORE, _AFTER))
    decoys = [f for line in _DECOYS for f in line.split("|")]
    make = {"name": _name, "email": _email, "phone": _phone, "address": _address}
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.choice((1, 2, 2, 3))):
            if text:
                text += r.choice((" ", " ", "\n", "\n\n", "  "))
            if r.random() < 0.45:
                text += _fill_decoy(r, r.choice(decoys))
                continue
            kinds = r.choice((("name",), ("name", "email"), ("name", "phone"), ("name", "name"), ("name", "name"), ("name", "name"), ("name", "id"), ("name", "id", "address"), ("name", "address"), ("email",), ("phone",), ("email", "phone"), ("phone", "email"), ("id",), ("address",), ("id", "address"), ("address", "name"), ("name", "phone", "email")))
            if r.random() < 0.25:
                text += r.choice(_PLAIN_TEXT) + " "
            for kind in kinds:
                cue, value = _id(r) if kind == "id" else ("", make[kind](r))
                if kind == "name" and text.endswith(" and "):
                    lead = ""
                else:
                    lead = "" if kind == "name" and r.random() < 0.2 else r.choice(before[kind]).replace("{cue}", cue)
                if text and (not lead or lead[0].isalnum()) and not text[-1].isspace() and text[-1] not in "([<":
                    text += " "
                text += lead
                gold.add((len(text), len(text) + len(value), {"id": "id_number"}.get(kind, kind)))
                text += value + (" and " if kinds == ("name", "name") and not text.endswith(" and ") and r.random() < 0.6 else r.choice(after[kind]))
        out.append((text, gold))
    return out
