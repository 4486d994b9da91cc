"""Personal information in free text by a semi-Markov conditional random field.

Proposal patterns give candidate spans of each type, with several boundaries each. Features of the whole
span and of the words beside it score every candidate; dynamic programming over the candidates, whose
length is bounded, picks the best set of spans that don't overlap, boundaries and types together. The
weights are trained on generated sentences (``pii_training``), not on the corpus.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.tables import spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: No span is longer than so many characters.
MAX_CHARS = 160

_SP = r"[ \t ]{1,4}"
_UP, _LO = "A-ZÀ-ÖØ-ÞŁŚŠŽČ", "a-zß-öø-ÿłńśšžčćąęığş"
_T = rf"[{_UP}][{_LO}'’]+"
_AT = rf"(?:[ \t]{{0,3}}@[ \t]{{0,3}}|[ \t]{{0,3}}[\[({{<][ ]?(?:at|AT)[ ]?[\])}}>][ \t]{{0,3}})"
_DOT = r"(?:\.|[ \t]{0,3}[\[({<][ ]?(?:dot|DOT)[ ]?[\])}>][ \t]{0,3})"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_EMAIL = re.compile(rf"(?<![\w.+\-@])[^\W_][\w.+\-]{{0,63}}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_SPELLED = re.compile(rf"(?<![\w.+\-@])[^\W_][\w.+\-]{{0,63}}{_SP}(?:at|AT){_SP}{_LABEL}(?:{_SP}(?:dot|DOT){_SP}{_LABEL})+")
_AT_SIGN, _BARE = re.compile(r"@|[\[({<][ ]?(?:at|AT)[ ]?[\])}>]"), re.compile(r"[ \t\u00a0](?:dot|DOT)[ \t\u00a0]")
_NUMBER = re.compile(r"(?<![\w@])(?<![\d][.\-/])(?:\+[ ]?|\()?\d(?:[ \t ]{0,3}[().\-/]?[ \t ]{0,3}\(?\d){5,17}(?![\d@])")
_GROUP = re.compile(r"[ \t ]+")
_ID = re.compile(r"(?<![\w\-@.])(?:[A-Z]{2,4}[- ]{0,2}\d{5,10}|[A-Z]\d{6,9}|[A-Z]{2}(?:[ ]{0,3}\d{2}){3}[ ]{0,3}[A-Z]|\d{7,8}[- ]?[A-Z]|[A-Z]\d{4,7}[A-Z]\d{0,3})(?![\w@])")
_NUM = r"\d{1,4}(?:[ ]{0,2}[a-z]\b)?"
_TOWN = rf"(?:[{_UP}][{_LO}]+|[{_UP}]{{3,}})(?:-(?:[{_UP}]?[{_LO}]+|[{_UP}]{{2,}})){{0,3}}"
_TOWNS = rf"{_TOWN}(?:[ ](?:{_TOWN}|(?:am|an|der|sur|de|la|del|upon)\b)){{0,2}}"
_GAP = r"(?:,[ \t]{0,4}\n?|[ \t]{0,3}\r?\n[ \t]{0,3}|[ \t]{1,4})"
_POST = r"[A-Z]{0,2}-?\d{4,5}(?:-\d{4})?"
_CAPS = rf"(?:[{_UP}][\w'’\-]+{_SP}){{1,3}}"
_WAY = r"(?i:street|st\b\.?|road|rd\b\.?|avenue|ave\b\.?|lane|ln\b\.?|drive|terrace|close|court|place|square|way|boulevard|blvd\b\.?|crescent|gardens|row|hill|park)"
_UNIT = rf"(?:(?i:flat|apt\.?|apartment|unit|suite|room){_SP}\w{{1,4}},?{_SP})?"
_ADDRESSES = [
    ("number street", re.compile(rf"(?<!\w){_UNIT}{_NUM},?{_SP}{_CAPS}{_WAY}(?:{_GAP}(?P<town>{_TOWNS}))?(?:{_GAP}(?P<post>{_POST})\b)?")),
    ("street number", re.compile(rf"(?<!\w)[{_UP}][\w\-]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer){_SP}{_NUM}(?:{_GAP}(?P<post>{_POST})\b)?(?:{_GAP}(?P<town>{_TOWNS}))?")),
    ("way name number", re.compile(rf"(?<!\w)(?i:calle|avenida|avda\.?|plaza|paseo|c/|via|viale|piazza){_SP}(?:(?:de|del|la|las|los){_SP}){{0,2}}(?:[{_UP}][\w'’\-]+,?{_SP}){{1,3}}{_NUM}(?:,{_SP}\d{{1,2}}[ºª°.]?{_SP}[A-Z]\b)?(?:{_GAP}(?P<post>{_POST})\b)?(?:{_GAP}(?P<town>{_TOWNS}))?")),
    ("number way name", re.compile(rf"(?<!\w)\d{{1,4}}(?:{_SP}(?:bis|ter|quater))?,?{_SP}(?i:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours){_SP}(?:(?:de|du|des|la|le|les){_SP}|l['’])*(?:[{_UP}][\w'’\-]+)(?:{_SP}[{_UP}][\w'’\-]+){{0,2}}(?:{_GAP}(?P<post>{_POST})\b)?(?:{_GAP}(?P<town>{_TOWNS}))?")),
]
_PART = rf"(?:(?:[Vv]an|VAN|[Vv]on|VON|[Dd]e|DE|[Dd]el|DEL|[Dd]er|DER|[Dd]en|[Dd]i|[Dd]a|[Ll]a|LA|[Tt]en|[Dd]os){_SP}){{0,2}}"
_SUR = rf"{_PART}(?:{_T}(?:-{_T})?|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})?)"
_FIRST = rf"(?:{_T}(?:-{_T})?|[{_UP}]{{2,}})"
_INI = rf"[{_UP}]\."
_NAMES = [
    ("first last", re.compile(rf"(?<![\w\-@.])(?=({_FIRST}{_SP}(?:{_INI}[ \t]{{0,3}}){{0,2}}{_SUR})(?![\w@]))")),
    ("first middle last", re.compile(rf"(?<![\w\-@.])(?=({_T}{_SP}{_T}{_SP}{_SUR})(?![\w@]))")),
    ("initial last", re.compile(rf"(?<![\w\-@.])(?=({_INI}[ \t]{{0,3}}(?:{_INI}[ \t]{{0,3}}){{0,2}}{_SUR})(?![\w@]))")),
    ("last, first", re.compile(rf"(?<![\w\-@.])(?=({_SUR},{_SP}(?:{_FIRST}(?:{_SP}{_INI})?|{_INI}))(?![\w@]))")),
]
_CUE_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")

#: Frequent given names of several languages, without accents, in lower case.
FIRST_NAMES = frozenset(
    """aisha alex alice amara amelie amina ana anders andrea andreas anna anne antonio astrid barbara beatriz ben bjorn
    bruno camille carla carlos carmen caroline cecile charles chiara christian clara claire daniel david diana diego
    elena elif elisa emil emile emily emma eric erik eva fatima felix fernando francois frank george giulia greta hanna
    hans helena helga henri henrik igor ines ingrid irina isabel ivan jack james jan jana jean jens john jonas jorge
    jose juan julia julie karl katarina kenji klaus laura lea lena leo lisa louis louise lucas lucia luis lukas magda
    manuel marc marco maria marie mario marta martin mary mateo max mei michael miguel mohamed nadia natalia nina noah
    noor olga oliver omar oscar pablo paolo patricia paul pedro peter petra philipp pierre priya rachel raj robert rosa
    ruben samuel sara sarah simon sofia sofie sophie stefan susan sven thomas tomas ursula vera victor viktor walter
    wei william yara yuki yusuf zara zoe""".split()
)
_PLAIN = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
_NOT_NAMES = frozenset(
    """the a an and or but both how whether we our these this that in on at by for from with without among across after before such some all
    no die der das dass den dem ein eine ohne bei nach unklar les le la el los las un una une sans que sin para por on dans il no notably surprisingly
    general hospital university institute department clinic center centre laboratory faculty school college street road""".split()
)


def _context(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """Three tokens to the left, nearest first, and three to the right, in lower case; a line break is a token."""
    left = [x.lower() for x in _CUE_WORD.findall(text[max(0, a - 40) : a])][-3:][::-1]
    right = [x.lower() for x in _CUE_WORD.findall(text[b : b + 30])][:3]
    pad = ["^"] * 3
    return (left + pad)[:3], (right + ["$"] * 3)[:3]


def _follows_capital(text: str, a: int) -> bool:
    """Whether only blanks part ``a`` from a word that begins with a capital."""
    end = len(text[max(0, a - 5) : a].rstrip(" \t\u00a0")) + max(0, a - 5)
    start = end
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "'’-_"):
        start -= 1
    return start < end < a and text[start].isupper()


def _shape(s: str) -> str:
    s = re.sub(r"\s+", " ", s)
    return re.sub(r"[a-zß-ÿ]", "x", re.sub(r"[A-ZÀ-Þ]", "X", re.sub(r"\d", "9", s)))


def _features(text: str, a: int, b: int, kind: str, form: str) -> list[str]:
    (l1, l2, l3), (r1, r2, _) = _context(text, a, b)
    f = [f"{kind}", f"{kind}|{form}", f"{kind}|l1={l1}", f"{kind}|l2={l2} {l1}", f"{kind}|r1={r1}", f"{kind}|r2={r1} {r2}"]
    if l1 in ".:(" or l1 == "^":
        f.append(f"{kind}|l3={l3} {l2}")
    span = text[a:b]
    if kind in ("phone", "id_number"):
        digits = sum(c.isdigit() for c in span)
        f += [f"{kind}|n={digits}", f"{kind}|shape={_shape(span)}", f"{kind}|start={'+' if span[0] == '+' else '(' if span[0] == '(' else '00' if span[:2] == '00' else '0' if span[0] == '0' else 'd'}"]
    elif kind == "name":
        ws = re.findall(rf"[{_UP}{_LO}'’]+", span)
        plain = [w.lower().translate(_PLAIN) for w in ws]
        lead = plain[-1] if form == "last, first" else plain[0]
        # an initial says nothing of the list
        known, upper = None if form == "initial last" else lead in FIRST_NAMES, all(w.isupper() for w in ws)
        f += [f"name|known={known}", f"name|{form} known={known}", f"name|upper={upper} known={known}", f"name|words={len(ws)}"]
        if _follows_capital(text, a):
            f.append(f"name|{form} after a capital word")
        if span[0].islower():
            f.append(f"name|{form} from {span.split()[0]}")
        if any(len(w) > 1 and w in _NOT_NAMES for w in plain):
            f.append("name|stop")
        if plain[0] in FIRST_NAMES and form == "last, first":
            f.append("name|reversed")
        if sum(w in FIRST_NAMES for w in plain) > 1:
            f.append("name|two first")
    return f


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(a, b, type, features) of every candidate span."""
    spans: dict[tuple[int, int, str], str] = {}
    for rx, sign in ((_EMAIL, _AT_SIGN), (_SPELLED, _BARE)):
        for m in rx.finditer(text) if sign.search(text) else ():
            form = "plain" if re.search(r"\S@\S", m[0]) else "spaced" if "@" in m[0] else "spelled"
            spans.setdefault((m.start(), m.end(), "email"), form)
    if any(c.isdigit() for c in text):
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            if text[b : b + 1].isalpha() and not text[b : b + 2][1:].isalnum():
                b_id = b + 1
            else:
                b_id = b
            ends = [(a, b)]
            cuts = [x.span() for x in _GROUP.finditer(text, a, b)]
            for x, y in cuts[-2:]:
                ends.append((a, x))
            for x, y in cuts[:2]:
                ends.append((y, b))
            for x, y in ends:
                if sum(c.isdigit() for c in text[x:y]) >= 6:
                    spans.setdefault((x, y, "phone"), "number")
                    if b_id == b and text[x] not in "+(":
                        spans.setdefault((x, y, "id_number"), "number")
        for m in _ID.finditer(text):
            spans.setdefault((m.start(), m.end(), "id_number"), "lettered")
        for form, rx in _ADDRESSES:
            for m in rx.finditer(text):
                a, ends = m.start(), {m.end(): ""}
                town, post = m.span("town"), m.span("post")
                form2 = f"{form} town={town[0] >= 0} post={post[0] >= 0}"
                if town[0] >= 0 and town[1] == m.end() and " " in m["town"]:
                    x = town[0]
                    for w in re.finditer(r"\S+", m["town"]):
                        ends.setdefault(x + w.end(), "")
                spans.setdefault((a, m.end(), "address"), form2)
                for e in ends:
                    spans.setdefault((a, e, "address"), form2 + " shorter")
                for last in (town, post):
                    if last[0] >= 0 and last[1] < m.end():
                        spans.setdefault((a, last[1], "address"), form2 + " cut")
    for form, rx in _NAMES:
        for m in rx.finditer(text):
            spans.setdefault((*m.span(1), "name"), form)
    out = []
    for (a, b, kind), form in spans.items():
        if 0 < b - a <= MAX_CHARS:
            out.append((a, b, kind, _features(text, a, b, kind, form)))
    return out


def _lattice(cands: list) -> tuple[list[int], dict[int, int]]:
    points = sorted({p for c in cands for p in c[:2]})
    return points, {p: i for i, p in enumerate(points)}


def decode(cands: list, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best-scoring set of candidates that don't overlap; ties leave the shorter reading."""
    scored = [(b, a, kind, s) for a, b, kind, f in cands if (s := sum(weights.get(x, 0.0) for x in f)) > 0]
    if not scored:
        return []
    points, at = _lattice([(a, b) for b, a, _, _ in scored])
    ending = defaultdict(list)
    for c in scored:
        ending[c[0]].append(c)
    best, back = [0.0] * len(points), [None] * len(points)
    for i, p in enumerate(points):
        if i:
            best[i] = best[i - 1]
        for c in sorted(ending[p]):
            v = best[at[c[1]]] + c[3]
            if v > best[i] + 1e-12:
                best[i], back[i] = v, c
    out, i = [], len(points) - 1
    while i >= 0:
        if back[i] is None:
            i -= 1
        else:
            b, a, kind, _ = back[i]
            out.append((a, b, kind))
            i = at[a]
    return out[::-1]


def _log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y > -math.inf else x


def gradient(cands: list, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> dict[str, float]:
    """Gradient of the log-likelihood of ``gold`` among all sets of candidates that don't overlap (forward-backward)."""
    points, at = _lattice(cands)
    n, scores = len(points), [sum(weights.get(x, 0.0) for x in f) for *_, f in cands]
    ending, starting = defaultdict(list), defaultdict(list)
    for k, (a, b, _, _) in enumerate(cands):
        ending[at[b]].append(k)
        starting[at[a]].append(k)
    alpha, beta = [0.0] * n, [0.0] * n
    for i in range(1, n):
        v = alpha[i - 1]
        for k in ending[i]:
            v = _log_add(v, alpha[at[cands[k][0]]] + scores[k])
        alpha[i] = v
    for i in range(n - 2, -1, -1):
        v = beta[i + 1]
        for k in starting[i]:
            v = _log_add(v, beta[at[cands[k][1]]] + scores[k])
        beta[i] = v
    z, g = alpha[-1], defaultdict(float)
    for k, (a, b, kind, f) in enumerate(cands):
        d = ((a, b, kind) in gold) - math.exp(alpha[at[a]] + scores[k] + beta[at[b]] - z)
        if abs(d) > 1e-4:
            for x in f:
                g[x] += d
    return g


def train(sentences: list[tuple[str, set[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.5, decay: float = 2e-3) -> dict[str, float]:
    """Weights by AdaGrad on the semi-Markov log-likelihood."""
    weights: dict[str, float] = defaultdict(float)
    square: dict[str, float] = defaultdict(float)
    prepared = [(c, gold) for t, gold in sentences if (c := candidates(t))]
    for _ in range(epochs):
        for cands, gold in prepared:
            for x, d in gradient(cands, gold, weights).items():
                d -= decay * weights[x]
                square[x] += d * d
                weights[x] += rate * d / math.sqrt(square[x] + 1e-8)
    return dict(weights)


@lru_cache(maxsize=4)
def trained(n_sentences: int = 4000, seed: int = 7) -> dict[str, float]:
    """The weights of ``n_sentences`` generated sentences."""
    from glossweave.llm.pii_training import sentences

    return train(sentences(n_sentences, seed))


def find_spans(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(a, b, type) in order of position."""
    return decode(candidates(text), weights)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[TYPE]`` for every span and everything else unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _per_text(docs: DataFrame, doc_id: str, text: str, schema: str, rows) -> DataFrame:
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    doc_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *r) for i, t in zip(pdf["id"], pdf["text"]) for r in rows(t, find_spans(t, weights.value) if t else [])]
            yield pd.DataFrame(out, columns=["id", *(c.split()[0] for c in schema.split(", "))])

    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return spread(source, "id").mapInPandas(run, f"id {doc_type}, {schema}").withColumnRenamed("id", doc_id)


def pii_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pii_type, a, b): every occurrence, positions counted in code points, half-open.

    Whole texts are read, each on its own, without a shuffle. Null and empty texts have none; repeated
    documents are reported each on their own; extra columns are ignored.
    """
    return _per_text(docs, doc_id, text, "pii_type string, a long, b long", lambda t, spans: [(k, a, b) for a, b, k in spans])


def mask_pii(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, masked, n_spans) for every text that is not null."""
    return _per_text(docs, doc_id, text, "masked string, n_spans long", lambda t, spans: [(mask(t, spans), len(spans))])
