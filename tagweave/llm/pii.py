"""Personal data inside free text: a skip-chain conditional random field.

A text becomes nodes.  Every run of two or more capitalised words (initials,
particles and a family name in capitals before a comma included) is a chain of
one node per word; every spelling of an e-mail address, every run of digits
and capitals of six signs or more, and every house number beside a street word
is a node of its own.  All other text is fixed to "no entity", which cuts the
chain without changing it.  The node grammar only says where an entity *may*
be; the labels come from the model: word shapes, learned given names, the words
around (title or function words are learned, not listed), number shapes,
separators, label words.

Weights are trained here (:func:`train`) on a bounded sample: tagged blocks
give true labels of all kinds but identity numbers, negatives included;
documents are labelled by bootstrapping (known given names, contexts in which
such names stand, telephone shapes of tagged blocks, words that label identity
numbers) and teach nothing where that can't tell.  Given names, telephone
shapes, contexts and frequent words are counted over all rows.

Skip edges join nodes of one document: equal surfaces, similar ones (case,
accents, a genitive s, digits written otherwise) and a name with a mail address
that holds it.  Their three potentials are trained too, by pseudo-likelihood.
Loopy belief propagation runs over chains and skip edges of a whole batch of
documents at once.  An exact check of the name grammar follows.

Pieces come out exactly as written; placeholders replace them in place.

Defined results: null and empty texts have no pieces; a piece that occurs twice
in a text is one row of :func:`find_rows`; repeated documents come out each;
without tagged blocks nothing teaches streets and telephone shapes, so only
addresses, labelled numbers and names in learned contexts are found; names in
scripts without capitals are not seen.
"""

from __future__ import annotations

import gc
import html
import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.model.crf import LinearChainCRF

LABELS = ["B", "EMAIL", "I", "ID", "O", "PHONE", "STREET"]
#: Rows of each training table, at most, and characters of a training text.
SAMPLE_DOCUMENTS = 700
SAMPLE_BLOCKS = 2000
SAMPLE_CHARS = 20_000
ROUNDS = 6
#: Shares, so that they hold at every size: of a word's occurrences that begin a
#: tagged person (given name), of a shape's that are tagged as a number
#: (telephone), of a context's with a known given name (name context), and of
#: all runs that a word stands in or beside (frequent).
GIVEN_SHARE = 0.5
SHAPE_SHARE = 0.5
CONTEXT_SHARE = 0.5
FREQUENT_SHARE = 0.001
#: A context has at least this share of all known given names in front of it.
CONTEXT_LEAST = 0.0005
#: A word that occurs less often is not frequent whatever its share.
OFTEN = 3

# --- spellings -------------------------------------------------------------------


def _capitals() -> str:
    """All capital letters as a character class body."""
    at = [c for c in range(0x41, 0x1F00) if unicodedata.category(chr(c)) in ("Lu", "Lt")]
    runs = [[at[0], at[0]]]
    for c in at[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


_UP = f"[{_capitals()}]"
_S = r"(?:[ \xa0\n]|&#160;|&nbsp;|~)"
_DOT = rf"(?:\.|{_S}?(?:\[dot\]|\(dot\)|\{{dot\}}|\[DOT\]|\(DOT\)){_S}?|{_S}(?:dot|DOT){_S})"
_AT = rf"(?:{_S}?(?:@|＠|﹫|&#64;|\\@){_S}?|{_S}?(?:\((?:at|AT|@)\)|\[(?:at|AT|@)\]|\{{(?:at|AT)\}}){_S}?|{_S}(?:at|AT){_S})"
_LABEL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ-]*[A-Za-z0-9À-ɏ])?"
_LOCAL = rf"[A-Za-z0-9À-ɏ](?:[\w+%-]|\\_)*(?:{_DOT}[\w+%-]+)*"
EMAIL = re.compile(rf"(?<![\w.+@-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])")
#: Where an address may be: its at sign, or a written "at" before a dotted name.
_EMAIL_HINT = re.compile(rf"[@＠﹫&(\[{{ \xa0\n;~](?:(?<=[@＠﹫])|(?<=&)#64;|(?<=[(\[{{])(?:at|AT|@)[)\]}}]|(?<=[ \xa0\n;~])(?:at|AT){_S}(?={_LABEL}{_DOT}[A-Za-z0-9]))")
#: Texts without this have no such place; it is the faster search.
_EMAIL_SIGNS = re.compile(rf"[@＠﹫&aA](?:(?<=[@＠﹫])|(?<=&)#64;|(?<=[aA])[tT](?:[)\]}}]|{_S}(?={_LABEL}{_DOT}[A-Za-z0-9])))")
_SIGN = re.compile(r"[@＠﹫]|&#64;")

_GAP = rf"(?:{_S}?[()/-]{{1,2}}{_S}?|\.|{_S}{{1,2}}(?<!\n\n))"
#: Digits with gaps; a sign in front is looked for behind.  (A single character
#: class in front lets the search skip all other text.)
DIGITS = re.compile(rf"\d\d*(?:{_GAP}\d+)*")
#: The same with times of day and their ranges in one piece, which is the group.
_TIMES_OR_DIGITS = re.compile(rf"\d(?:(\d?:\d\d?(?!\d|{_GAP}\d)(?:[:–]\d\d?(?!\d|{_GAP}\d))*)|\d*(?:{_GAP}\d+)*)")
_FRONT = re.compile(rf"[+(]{_S}?\Z")
_BLANKS = re.compile(rf"{_S}+")
_AROUND = re.compile(r" ?([^\w ]) ?")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_HOUSE = re.compile(r"\d{1,5}[a-zA-Z]?(?![\w])")
_CODE = re.compile(r"[A-Z\d]+(?:[ .-][A-Z]{0,4}\d[A-Z\d]*)*(?:(?<=\d)[ -][B-DF-HJ-NP-TV-XZ](?![\w'’]))?")
_PREFIX = re.compile(rf"(?<![\w-])[A-Z]{{1,2}}{_S}\Z")

_NAMEWORD = rf"(?:{_UP}|&#(?!160;)\d+;|&[A-Z]\w+;)(?:[^\W\d_]|[̀-ͯ]|&#\d+;|&[A-Za-z]+;|['’-](?=[^\W\d_]|&))*"
# Words that make a street of a name.
STREET_TYPES = "Street St. Avenue Ave Ave. Road Rd. Rd Lane Ln Drive Blvd Boulevard Court Square Way Place Crescent Terrace Close Row Mews Grove Gardens Parkway Highway Quay Walk".split()
STREET_LEADS = "rue avenue place bd boulevard quai chemin allée impasse cours route square passage".split()
STREET_CALLS = ["Calle", "C/", "Plaza", "Avenida", "Avda.", "Paseo", "Camino", "Ronda", "Travesía", "Carretera", "Via", "Viale", "Corso", "Piazza", "Rua", "ulica", "ul."]
STREET_ENDS = "straße strasse str. platz weg gasse allee ufer damm ring steig markt straat laan plein kade gracht dijk singel gatan vägen vej gade".split()
_NO = r"\d{1,5}[a-zA-Z]?(?![\w])"
_DIRECTION = r"(?:Old|New|North|South|East|West|Upper|Lower|Great|Little)"
STREET = re.compile(
    rf"{_NO}(?:{_S}(?:bis|ter|quater))?(?:,?{_S}(?:{'|'.join(STREET_LEADS)}){_S}(?:(?:de{_S}la|de{_S}l['’]|des|du|de|d['’]){_S}?)?{_NAMEWORD}(?:{_S}(?!\d){_NAMEWORD})?"
    rf"|{_S}(?:{_DIRECTION}{_S})?{_NAMEWORD}(?:{_S}{_NAMEWORD})?{_S}(?:{'|'.join(t.replace('.', '[.]') for t in STREET_TYPES)})(?![\w]))"
)
#: Streets with the number behind.
STREET_BEHIND = re.compile(
    rf"(?<![\w.,/-])(?:(?:{'|'.join(re.escape(c) for c in STREET_CALLS)}){_S}(?:(?:de{_S}la|del|de|la){_S})?{_NAMEWORD}(?:{_S}{_NAMEWORD})?,?{_S}(?:n[.º°]{_S})?{_NO}"
    rf"|(?:(?:Am|An{_S}der|Im|Zum|Zur|Auf{_S}dem){_S})?(?:{_NAMEWORD}{_S}(?:Allee|Straße|Platz|Weg|Ring|Ufer|Laan|Plein)|{_NAMEWORD}(?:{'|'.join(e.replace('.', '[.]') for e in STREET_ENDS)}|-Ufer|-Allee|-Platz|-Straße|-Weg)){_S}{_NO})"
)
_CALL = re.compile(rf"(?:{'|'.join(re.escape(c) for c in STREET_CALLS)})(?={_S})")
#: How the last word of a street with the number behind ends, unless it is called.
_STREET_LAST = (*STREET_ENDS, "Allee", "Straße", "Platz", "Weg", "Ring", "Ufer", "Laan", "Plein")
_NUMBER_FIRST = re.compile(rf"(?:[a-zA-Z](?!\w))?(?:{_S}(?:bis|ter|quater))?,?{_S}(?:{_UP}|&|(?:{'|'.join(STREET_LEADS)})(?!\w))")

# Words in front of a family name.
PARTICLES = {"von", "van", "der", "den", "de", "la", "du", "des", "del", "di", "da", "dos", "zu", "zum", "zur", "ter", "ten", "le", "el", "af", "av", "y", "e", "und"}
_PARTICLE = "(?:" + "|".join(f"{c}(?:{'|'.join(p[1:] for p in sorted(PARTICLES) if p[0] == c)})" for c in sorted({p[0] for p in PARTICLES})) + ")(?:['’]|(?![\\w'’]))"
_REST = r"(?:[^\W\d_]++|[̀-ͯ]|&#\d+;|&[A-Za-z]+;|['’-](?=[^\W\d_]|&))*+"
_WORD = rf"{_UP[:-1]}&](?:(?<=&)(?:#(?!160;)\d+;|[A-Z]\w+;){_REST}|(?<!&)(?:\.(?:-{_UP}\.)?|{_REST}))"
RUN = re.compile(rf"{_WORD}(?:,?{_S}{{1,3}}(?:{_PARTICLE}{_S}*)*{_WORD})+")
_PART = re.compile(rf"{_WORD}|{_PARTICLE}|,")
_SIMPLE = re.compile(r"[^\W\d_]++(?: [^\W\d_]++)++")
_INITIAL = re.compile(r"[^\W\d_]\.(?:-[^\W\d_]\.)?$")
_CAPS = re.compile(rf"{_UP}{{2,}}(?:['’-]?{_UP}+)*$")
_ELIDED = re.compile(r"[LDQS]['’][^\W\d_]")
_TOKEN = re.compile(r"[^\W\d_]+| ?[^\w\s]")  # a blank before a sign tells French from others
_AFTER = re.compile(rf"{_S}*([^\W\d_]+|\S)")
_LEFT = re.compile(r"[^\W\d_][^\W_]*|[^\w\s]")

# Words that label a number.
PHONE_LABEL = re.compile(rf"\b(?:tel(?:ephone|ef(?:oon|on|ax|ono))?|tél(?:éphone|écopie)?|phone|fax|call|mobile?|móvil|handy|gsm|rufnummer|durchwahl)\b(?: (?:number|no\.?|nr\.?|n°))?[.:]?{_S}?:?{_S}?$", re.I)
ID_LABEL = re.compile(
    r"(?:\bSSN|passport(?:\s+no\.)?|identity\s+number|tax\s+number|insurance\s+number|Personal\s+ID|ID\s+card|Ausweisnummer|Steuer-ID|Reisepass\s*Nr\.?|Sozialversicherungsnummer|passeport\s+n°|carte\s+d[’']identité|sécurité\s+sociale|n°\s+fiscal"
    r"|\bDNI|\bNIE|pasaporte|\bNIF|seguridad\s+social|\bBSN|paspoort|rijbewijs|identiteitskaart|numéro\s+de\s+[\w ]{3,20})[\s\xa0]*(?:n°|nr\.?|no\.?)?[\s\xa0]*:?[\s\xa0]*$",
    re.I,
)
#: How labels end that are written in ASCII.
_ID_LAST = ("nr", "nr.", "no", "no.", "ssn", "passport", "number", "id", "card", "nummer", "fiscal", "dni", "nie", "pasaporte", "nif", "social", "sociale", "bsn", "paspoort", "rijbewijs", "identiteitskaart")
_LABEL_WORDS = {"SSN", "DNI", "NIE", "NIF", "BSN", "ID", "NO", "NR", "TEL", "FAX", "REF", "PO"}


@dataclass(slots=True)
class Node:
    start: int
    end: int
    text: str
    features: tuple[str, ...]
    zone: int
    kind: str


@dataclass
class Knowledge:
    """What training gathers: counted over all rows, and the weights."""

    given: frozenset[str] = frozenset()
    frequent: frozenset[str] = frozenset()
    contexts: frozenset[str] = frozenset()
    shapes: frozenset[str] = frozenset()
    crf: LinearChainCRF = field(default_factory=LinearChainCRF)
    #: potentials of the skip edges: equal, similar, name and mail address
    skip: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _ends: frozenset[str] | None = None

    @property
    def ends(self) -> frozenset[str]:
        """The last tokens of the contexts."""
        if self._ends is None:
            self._ends = frozenset(x for c in self.contexts for x in (_TOKEN.findall(c)[-1], _TOKEN.findall(c)[-1].lstrip()))
        return self._ends

    def save(self, spark: SparkSession, path: str) -> None:
        """As tables: the weights, and one row of everything else."""
        state, transition = self.crf.to_rows()
        spark.createDataFrame(state or [("", self.crf.labels[0], 0.0)], "feature string, label string, weight double").write.mode("overwrite").parquet(f"{path}/state_weights")
        spark.createDataFrame(transition, "from_label string, to_label string, weight double").write.mode("overwrite").parquet(f"{path}/transition_weights")
        rest = {"given": sorted(self.given), "frequent": sorted(self.frequent), "contexts": sorted(self.contexts), "shapes": sorted(self.shapes), "skip": self.skip}
        spark.createDataFrame([(json.dumps(rest),)], "knowledge string").write.mode("overwrite").parquet(f"{path}/knowledge")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Knowledge":
        state, transition = ([tuple(r) for r in spark.read.parquet(f"{path}/{t}").collect()] for t in ("state_weights", "transition_weights"))
        rest = json.loads(spark.read.parquet(f"{path}/knowledge").first().knowledge)
        return cls(*(frozenset(rest[k]) for k in ("given", "frequent", "contexts", "shapes")), LinearChainCRF.from_rows(state, transition), tuple(rest["skip"]))


def _plain(w: str) -> str:
    return html.unescape(w) if "&" in w else w


@lru_cache(maxsize=100_000)
def _shape(w: str) -> str:
    w = _plain(w)
    if w == ",":
        return ","
    if _INITIAL.match(w):
        return "initial"
    if _CAPS.match(w):
        return "caps"
    if w[:1].islower() and w.rstrip("'’").lower() in PARTICLES:
        return "particle"
    if "-" in w:
        return "double" if all(p[:1].isupper() for p in w.split("-")) else "mixed"
    return "cap" if w[:1].isupper() else "low"


@lru_cache(maxsize=10_000)
def number_shape(s: str) -> str:
    """Digits as 9, letters as A, blanks as one and none around signs."""
    return _LETTER.sub("A", _DIGIT.sub("9", _AROUND.sub(r"\1", _BLANKS.sub(" ", s))))


@lru_cache(maxsize=10_000)
def _shape_parts(shape: str) -> tuple[str, str]:
    """Of a number's shape: its separators, and its runs of digits and letters."""
    return "".join(sorted(set(re.sub(r"\w", "", shape)))), re.sub("9+", "9", re.sub("A+", "A", shape))


# --- nodes -----------------------------------------------------------------------


_DOT_BEFORE = re.compile(rf"{_DOT}\Z")


def _address(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The mail address over place ``at``: searched from ever further back while
    it may begin before the stretch that is searched, so without a fixed reach."""
    reach = 40
    while True:
        start, stop = max(low, at - reach), min(len(text), at + reach + 60)
        got = next((m.span() for m in EMAIL.finditer(text, start, stop) if m.start() <= at < m.end()), None)
        whole = start == low and stop == len(text)
        if got and (whole or got[1] < stop - 8 and (start == low or got[0] > start and not _DOT_BEFORE.search(text, max(0, got[0] - 9), got[0]))):
            return got
        if whole or not got and re.search(r"\s", text[start : max(start, at - 12)]) and re.search(r"\s", text[at + 12 : stop]):
            return got
        reach *= 2


def _street(text: str, a: int, b: int, flat: str, calls: int) -> tuple[int, int] | None:
    """The street around the house number whose digits go from ``a`` to ``b``;
    ``flat`` is the text with every blank written alike, ``calls`` the place of
    the first word that calls what follows a street."""
    if a > 1 and (blank := text[a - 1]) in " \xa0\n;~":
        k = flat.rfind(" ", 0, a - 1) + 1
        c = text[k]
        # number behind: a call before the name, or a name that ends as streets do
        if (c.isupper() or c in "n&" or "-" in text[k:a]) and (calls < a or blank in ";~" or flat.endswith(_STREET_LAST, k, a - 1)) and (house := _HOUSE.match(text, a)):
            for _ in range(8):  # as many words as the pattern has
                k = max(0, flat.rfind(" ", 0, k))
            found = next((x.span() for x in STREET_BEHIND.finditer(text, k, house.end()) if x.end() == house.end()), None)
            if found:
                return found
    return (x := STREET.match(text, a)) and x.span() if _NUMBER_FIRST.match(text, b) else None


def _code(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The number with capitals around the digits from ``a`` to ``b``."""
    k = a
    while k and (text[k - 1].isdigit() or "A" <= text[k - 1] <= "Z"):
        k -= 1
    if k == a and (p := _PREFIX.search(text, max(0, a - 9), a)) and p.group().strip() not in _LABEL_WORDS:
        k = p.start()
    x = _CODE.match(text, k) if text[k] not in "+(" else None
    if not x or x.end() < b:
        return None
    e = x.end()
    if text[e - 2] == " " and text[e - 1].isalpha() and text[k].isdigit():
        e -= 2  # a letter behind a blank belongs to numbers that begin with letters
    s = text[k:e]
    return (k, e) if _whole(text, k, e) and sum(c.isalnum() for c in s) > 4 and any(c.isalpha() for c in s) else None


def _numbers(text: str, shapes: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of numbers and of streets around house numbers."""
    done = 0
    flat = calls = None
    for m in _TIMES_OR_DIGITS.finditer(text):
        if m.lastindex:
            continue
        a, b = m.span()
        if a < done:
            continue
        if flat is None:
            flat = text.replace("\n", " ").replace("\xa0", " ")
            calls = c.start() if (c := _CALL.search(text)) else len(text)
        before, after = text[a - 1 : a] if a else "", text[b : b + 1]
        if b - a < 3 and (after == ":" or before == ":" or before == "–"):
            continue  # times of day
        if b - a < 6 and (before == "" or before in " \xa0\n;~(>*[{") and (street := _street(text, a, b, flat, calls)):
            done = street[1]
            yield "street", *street
            continue
        if "A" <= before <= "Z" or "A" <= after <= "Z" or after and after in "- " and "A" <= text[b + 1 : b + 2] <= "Z" or before and before in " \xa0;" and ("A" <= text[a - 2 : a - 1] <= "Z" or before == ";") and _PREFIX.search(text, max(0, a - 9), a):
            if code := _code(text, a, b):
                done = code[1]
                yield "number", *code
                continue
        s = m.group()
        if len(s) < 4 or len(s) < 6 and s.isdecimal():
            continue  # too few digits, and none to cut off for a street
        if before and (before in "+(;" or before in " \xa0" and text[a - 2 : a - 1] in ("+", "(")) and (front := _FRONT.search(text, max(0, a - 7), a)):
            a = front.start()
            s = text[a:b]
        cut = max(s.rfind(" "), s.rfind("\n"), s.rfind("\xa0"), s.rfind(";"), s.rfind("~"))
        if cut > 0 and number_shape(s) not in shapes and (street := _street(text, a + cut + 1, b, flat, calls)):
            yield from _split(text, a, max(a, min(a + cut, street[0])), shapes)
            done = street[1]
            yield "street", *street
        else:
            yield from _split(text, a, b, shapes)


def _whole(text: str, a: int, b: int) -> bool:
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    return not (before.isalnum() or before in ("_", "+", ".", ",", "/", "-") and before) and not (after.isalnum() or after == "_" or after in ("-", ".", "/") and text[b + 1 : b + 2].isdigit())


def _split(text: str, a: int, b: int, shapes: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """A run of digits, or the stretches of it that have a telephone's shape:
    blanks may also stand between two numbers."""
    s = text[a:b]
    if len(s) < 6 or sum([c.isdigit() for c in s]) < 6:
        return
    if number_shape(s) not in shapes:
        cuts = [0, *[x for m in re.finditer(rf"{_S}+", s) for x in m.span()], len(s)]
        starts, ends = cuts[::2], cuts[1::2]
        if len(starts) > 1:
            out, i = [], 0
            while i < len(starts):
                j = next((j for j in range(len(ends) - 1, i - 1, -1) if number_shape(s[starts[i] : ends[j]]) in shapes), None)
                if j is None:
                    i += 1
                else:
                    out.append((a + starts[i], a + ends[j]))
                    i = j + 1
            if out:
                yield from (("number", x, y) for x, y in out if _whole(text, x, y))
                return
    if s[0] == "(" and ")" not in s:
        a += 1
    if _whole(text, a, b):
        yield "number", a, b


def _id_label(text: str, a: int) -> bool:
    """Whether a word that labels identity numbers stands before a place."""
    back = text[max(0, a - 60) : a].lower().rstrip()
    last = (back[:-1].rstrip() if back[-1:] == ":" else back)[-20:]
    if last.isascii() and not last.endswith(_ID_LAST) and "um" not in back:  # "um": of the open label in French
        return False
    return ID_LABEL.search(text, max(0, a - 60), a) is not None


def _unit_features(kind: str, text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    left = _LEFT.findall(text[max(0, a - 40) : a].lower())[-3:]
    right = _LEFT.findall(text[b : b + 14].lower())[:1]
    out = [f"kind={kind}", f"k+l1={kind}|{left[-1] if left else '^'}", f"k+r1={kind}|{right[0] if right else '$'}"]
    if kind == "number":
        shape = number_shape(s)
        label = "id" if _id_label(text, a) else "phone" if PHONE_LABEL.search(text, max(0, a - 40), a) else ""
        n, lead = sum(c.isdigit() for c in s), s[0] if s[0] in "+(0" else "A" if s[0].isalpha() else "9"
        seps, runs = _shape_parts(shape)
        out += [f"label={label}", f"seps={seps}|{lead}", f"runs={runs}", f"lead={lead}|{min(n, 16)}", f"lead+label={lead}|{label}", f"first={lead}|{len(re.match(r'[^0-9]*([0-9]*)', s).group(1))}", f"shape={shape}", f"digits={min(n, 24)}"]
        out += [f"left={w}" for w in left]
    elif kind == "email":
        sign = "@" if _SIGN.search(s) else "brackets" if re.search(r"[(\[{]", s) else "written"
        out += [f"at={sign}", f"dots={sign}|{'.' in s}", f"at+l1={sign}|{left[-1] if left else '^'}", f"local={sign}|{min(len(re.split(_AT, s)[0]), 3)}"]
    else:
        words = re.findall(r"[^\W\d_]+[.]?", s.lower())
        out += [f"first={words[0] if words else ''}", f"last={words[-1] if words else ''}", f"end={words[-1][-4:] if words else ''}", f"behind={s[0].isalpha()}"]
    return out


def _words_of(text: str, a: int, b: int) -> list[list[tuple[int, int, str]]]:
    """Words of a run; cut at commas but behind a family name in capitals."""
    out: list[list[tuple[int, int, str]]] = [[]]
    for m in _PART.finditer(text, a, b):
        w = m.group()
        here = out[-1]
        if w == ",":
            if here and _CAPS.match(_plain(here[-1][2])):
                here.append((m.start(), m.end(), w))
            else:
                out.append([])
        elif here or not w[:1].islower():
            here.append((m.start(), m.end(), w))
    return out


def runs_of(text: str, taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, str]]]:
    """Every run of two or more capitalised words outside of ``taken``."""
    taken = sorted(taken)
    k = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if a and (c := text[a - 1]) not in " \n" and (c.isalnum() or c in "@#_" or c == "." and text[a - 2 : a - 1].isalnum()):
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        free = k == len(taken) or taken[k][0] >= b
        if free and _SIMPLE.fullmatch(s := m.group()):
            w, *rest = s.split(" ")
            simple = [(a, e := a + len(w), w)]
            for w in rest:
                simple.append((e + 1, e := e + 1 + len(w), w))
            yield simple
            continue
        plain = free and "\n" not in text[a:b]
        for words in _words_of(text, a, b):
            if plain:
                if len(words) > 1:
                    yield words
                continue
            parts: list[list[tuple[int, int, str]]] = [[]]
            for w in words:
                if any(x < w[1] and w[0] < y for x, y in taken[k : k + 8]):
                    parts.append([])
                elif parts[-1] and "\n" in (gap := text[parts[-1][-1][1] : w[0]]) and gap.count("\n") > 1:
                    parts.append([w])
                else:
                    parts[-1].append(w)
            yield from (p for p in parts if len(p) > 1)


def _is_given(w: str, given: frozenset[str]) -> bool:
    p = _plain(w)
    return p in given or p.isupper() and p.title() in given or "-" in p and p.split("-")[0] in given


def _known(words: list[tuple[int, int, str]], given: frozenset[str]) -> list[bool]:
    return [_is_given(w, given) for _, _, w in words]


#: Spellings in a table of words, at most; it begins anew beyond.
WORDS_HELD = 100_000


class _Words(dict):
    """What a run's words tell by themselves, worked out once a spelling: shape,
    whether a known given name, the word (a rare one is #), the word in small
    letters, whether a context may end with it, the word folded (none if no
    skip edge goes by it)."""

    def __init__(self, know: Knowledge, given: frozenset[str]) -> None:
        self.given, self.frequent, self.contexts, self.ends = given, know.frequent, know.contexts, know.ends

    def __missing__(self, w: str) -> tuple[str, bool, str, str, bool, str | None]:
        if len(self) >= WORDS_HELD:
            self.clear()
        plain = _plain(w)
        low = plain.lower().rstrip(".")
        got = self[w] = (
            _shape(w), _is_given(w, self.given), low if low in self.frequent or not low[:1].isalpha() else "#", low, low in self.ends,
            _folded(plain) if len(w) > 3 and not w[:1].islower() else None,
        )
        return got


_WORDS: list[_Words] = []


def _words_told(know: Knowledge, given: frozenset[str]) -> _Words:
    """The table of words for what is known now; two are kept (training hides
    the given names by turns)."""
    for table in _WORDS:
        if table.given is given and table.frequent is know.frequent and table.contexts is know.contexts:
            return table
    _WORDS[1:] = []
    _WORDS.insert(0, _Words(know, given))
    return _WORDS[0]


def _contexts(before: list[str], i: int) -> tuple[str, str, str]:
    """The last token before word ``i``, the last two, the last three;
    ``before`` has the three tokens before the run and its words."""
    l1 = before[i + 2]
    l2 = f"{before[i + 1]} {l1}"
    return l1, l2, f"{before[i]} {l2}"


def _token_before(text: str, a: int) -> str:
    """The last of :func:`_outside`, without the others."""
    j = a - 1
    low = max(-1, a - 41)
    if a and text[j] == " " and (k := text.rfind(" ", low + 1, j)) >= 0 and (w := text[k + 1 : j]).isalpha():
        return w.lower()
    breaks = 0
    while j > low:
        c = text[j]
        if c.isalpha():
            k = j
            while k > low and text[k].isalpha():
                k -= 1
            return text[k + 1 : j + 1].lower()
        if c == "\n":
            breaks += 1
            if breaks > 1:
                return "^"
        else:
            breaks = 0
            if c in ";~":
                return _outside(text, a)[-1]  # an encoded blank, perhaps
            if not (c.isalnum() or c == "_" or c.isspace()):
                return " " + c if j - 1 > low and text[j - 1] in " \xa0" else c
        j -= 1
    return "^"


def _outside(text: str, a: int) -> list[str]:
    """Three tokens before a place; a paragraph's or text's beginning is ^."""
    back = text[max(0, a - 40) : a].lower()
    words = back[:-1].rsplit(" ", 3)
    if len(words) == 4 and back[-1] in " \n" and words[2].isalpha():
        last = words[3]
        if last.isalpha():
            if words[1].isalpha():
                return words[1:]
        elif last[-1:] in (".", ",", ":") and last[:-1].isalpha():
            return [words[2], last[:-1], last[-1]]
    back = back.replace("\xa0", " ")
    cut = back.rfind("\n\n")
    if cut >= 0:
        back = back[cut + 2 :]
    if "&" in back or "~" in back:
        back = _BLANKS.sub(" ", back)
    elif (k := back.find(" ", max(0, len(back) - 24))) > 0 and len(words := _TOKEN.findall(back, k)) > 2:
        return words[-3:]  # no token goes over a blank, so the last ones are the same without the rest
    return ["^", "^", "^", *_TOKEN.findall(back)][-3:]


#: All that a run's features depend on: shapes, known given names, words (a
#: rare one is #), contexts, the token before, the token behind, line breaks
#: within, an elided article in front.
Key = tuple[tuple[str, ...], tuple[bool, ...], tuple[str, ...], tuple[str, ...], str, str, tuple[int, ...], bool]


def _run_key(text: str, words: list[tuple[int, int, str]], know: Knowledge, told: list[tuple]) -> Key:
    """``told`` has what :class:`_Words` tells of each word."""
    frequent, contexts, ends = know.frequent, know.contexts, know.ends
    shapes, known, keys, lows, end, _ = zip(*told)
    a, b = words[0][0], words[-1][1]
    front = _token_before(text, a)
    if front in ends or True in end[:-1]:
        before = ["", "", front, *lows]
        found = []
        for i in range(len(words)):
            l1, c = before[i + 2], ""
            if l1 in ends:
                if not before[0]:
                    before[:3] = _outside(text, a)
                _, l2, l3 = _contexts(before, i)
                c = l3 if l3 in contexts else l2 if l2 in contexts else l1 if l1 in contexts else ""
            found.append(c)
        front, behind = before[2], tuple(found)
    else:
        behind = ("",) * len(words)
    after = text[b : b + 1]
    if after not in (".", ",", ":"):
        m = _AFTER.match(text, b)
        after = m.group(1).lower() if m else "$"
    wrapped = tuple([i for i in range(1, len(words)) if "\n" in text[words[i - 1][1] : words[i][0]]]) if text.find("\n", a, b) >= 0 else ()
    return (
        shapes, known, keys, behind, front if front in frequent or not front[:1].isalpha() else "#", after if after in frequent or not after[:1].isalpha() else "#",
        wrapped, shapes[0] == "cap" and words[0][2][1:2] in ("'", "’") and _ELIDED.match(words[0][2]) is not None,
    )


@lru_cache(maxsize=100_000)
def _run_features(key: Key) -> tuple[tuple[str, ...], ...]:
    """Features of each word of a run."""
    shapes, known, keys, contexts, front, after, wrapped, elided = key
    n = len(shapes)
    flags = ["1" if k else "0" for k in known]
    out = []
    for i, s in enumerate(shapes):
        g, p, nxt = flags[i], keys[i - 1] if i else front, keys[i + 1] if i + 1 < n else "$" + after
        f = [
            f"s={s}|{g}|{min(i, 2)}", f"sp={shapes[i - 1] if i else '^'}|{s}|{shapes[i + 1] if i + 1 < n else '$'}", f"g={flags[i - 1] if i else '^'}|{g}|{s}",
            f"left={n - i if n - i < 4 else 4}|{s}|{min(i, 3)}", f"h={'/'.join(shapes[max(0, i - 3) : i])}|{s}", f"p={p}|{s}|{g}", f"n={nxt}|{s}", f"c={contexts[i]}",
        ]
        if keys[i][:1].isalpha():
            f += [f"w={keys[i]}", f"wp={keys[i]}|{p}"]
        if i == 0:
            f.append(f"start={p}|{n if n < 4 else 4}|{nxt}")
            if elided:
                f.append("elided")
        elif i in wrapped:
            f.append(f"wrapped={shapes[i - 1]}|{s}|{g}")
        out.append(tuple(f))
    return tuple(out)


def _run_nodes(words: list[tuple[int, int, str]], key: Key, zone: int) -> list[Node]:
    return [Node(a, b, w, f, zone, "word") for (a, b, w), f in zip(words, _run_features(key))]


def units(text: str, shapes: frozenset[str]) -> list[tuple[str, int, int]]:
    """Addresses, streets and numbers that don't overlap."""
    out: list[tuple[str, int, int]] = []
    done = 0
    for h in _EMAIL_HINT.finditer(text) if _EMAIL_SIGNS.search(text) else ():
        if h.start() >= done:
            if got := _address(text, h.start(), done):
                done = got[1]
                out.append(("email", *got))
    mails = len(out)
    done, k = 0, 0
    for kind, a, b in _numbers(text, shapes):
        while k < mails and out[k][2] <= a:
            k += 1
        if a >= done and not (k < mails and out[k][1] < b):
            done = b
            out.append((kind, a, b))
    return out


def _unit_nodes(text: str, found: list[tuple[str, int, int]]) -> list[Node]:
    return [Node(a, b, text[a:b], tuple(_unit_features(kind, text, a, b)), i, kind) for i, (kind, a, b) in enumerate(found)]


def zones(text: str, know: Knowledge, given: frozenset[str] | None = None) -> list[Node]:
    """All nodes of a text; ``given`` replaces the known given names."""
    given = know.given if given is None else given
    found = units(text, know.shapes)
    nodes = _unit_nodes(text, found)
    zone = len(nodes)
    table = _words_told(know, given)
    for words in runs_of(text, [(a, b) for _, a, b in found]):
        nodes += _run_nodes(words, _run_key(text, words, know, [table[w] for _, _, w in words]), zone)
        zone += 1
    return nodes


# --- inference -------------------------------------------------------------------

_AGREE = np.zeros((3, len(LABELS), len(LABELS)))
for _i, _a in enumerate(LABELS):
    for _j, _b in enumerate(LABELS):
        _AGREE[0, _i, _j] = _AGREE[1, _i, _j] = _a == _b or {_a, _b} <= {"B", "I"}
_AGREE[2, LABELS.index("EMAIL"), [LABELS.index("B"), LABELS.index("I")]] = 1
_ALLOWED = {"word": ("B", "I", "O"), "email": ("EMAIL", "O"), "number": ("PHONE", "ID", "O"), "street": ("STREET", "O")}
_KINDS = {k: i for i, k in enumerate(_ALLOWED)}
_BARRED = np.array([[0.0 if x in v else -1e3 for x in LABELS] for v in _ALLOWED.values()])
_TYPE = {"EMAIL": "email", "PHONE": "phone", "ID": "id_number", "STREET": "street"}


def _folded(w: str) -> str:
    """Case, accents and a genitive s aside."""
    w = w.lower()
    if not w.isascii():
        w = unicodedata.normalize("NFD", w).encode("ascii", "ignore").decode() or w
    return w[:-1].rstrip("'’") if w[-1:] == "s" else w


def _locals(address: str) -> list[str]:
    """Words of a mail address's local part, as names are folded."""
    return [_folded(p) for p in re.findall(r"[^\W\d_]{4,}", re.split(_AT, address)[0])]


def skip_edges(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """``(node, node, kind)`` with equal (0) or similar (1) surfaces, and mail
    addresses with names (2): a chain through each group, not all pairs."""
    equal: dict[str, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        if n.kind != "word" or len(n.text) > 3 and not n.text[:1].islower():
            equal[n.kind + ":" + n.text].append(i)
    edges = [(a, b, 0) for g in equal.values() if len(g) > 1 for a, b in zip(g, g[1:])]
    similar: dict[str, list[int]] = defaultdict(list)
    words: dict[str, int] = {}
    for key, g in equal.items():
        kind, _, s = key.partition(":")
        if kind == "word":
            s = _folded(_plain(s))
            words.setdefault(s, g[0])
        elif kind == "number":
            s = re.sub(r"\W", "", s)
        else:
            s = "".join(s.lower().split())
        similar[f"{kind}:{s}"].append(g[0])
    edges += [(a, b, 1) for g in similar.values() if len(g) > 1 for a, b in zip(g, g[1:])]
    for i, n in enumerate(nodes):
        if n.kind == "email":
            edges += [(i, words[p], 2) for p in _locals(n.text) if p in words]
    return edges


def propagate(scores: np.ndarray, edges: np.ndarray, kinds: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over all edges of a batch; beliefs (nodes, labels)."""
    n, L = scores.shape
    if not len(edges):
        return scores
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    E, K = len(edges), len(potentials)
    kind = np.r_[kinds, kinds + K]
    P = np.exp(np.concatenate([potentials.transpose(0, 2, 1), potentials]))
    groups = [(g, P[k]) for k in range(2 * K) if len(g := np.flatnonzero(kind == k))]  # edges of one potential meet it in one product
    order = np.argsort(b, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0])
    targets = b[order][starts]
    # labels in rows, so that the largest is found along whole rows; arrays of this size are costly to get, so they are used again
    scores = np.ascontiguousarray(scores.T)
    messages, out, new = np.zeros((3, L, 2 * E))
    belief = scores.copy()
    for _ in range(rounds):
        np.take(belief, a, axis=1, out=out, mode="clip")
        out[:, :E] -= messages[:, E:]
        out[:, E:] -= messages[:, :E]
        out -= out.max(0)
        np.exp(out, out=out)
        for g, potential in groups:
            new[:, g] = potential @ out[:, g]
        new += 1e-300
        np.log(new, out=new)
        new -= new.max(0)
        messages *= 0.3
        new *= 0.7
        messages += new
        np.take(messages, order, axis=1, out=out, mode="clip")
        belief[:, targets] = scores[:, targets] + np.add.reduceat(out, starts, axis=1)
    return belief.T


def _unary(nodes: list[Node], crf: LinearChainCRF, order: list[int]) -> np.ndarray:
    get = crf.vocabulary.get
    rows: list[int] = []
    starts: list[int] = []
    shared: dict[tuple[str, ...], int] = {}  # equal features are summed once
    which = []
    for n in nodes:
        k = shared.get(n.features)
        if k is None:
            k = shared[n.features] = len(starts)
            starts.append(len(rows))
            rows += [r for f in n.features if (r := get(f)) is not None]
        which.append(k)
    starts.append(len(rows))
    at = np.array(starts)
    out = np.zeros((len(shared), len(LABELS)))
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = np.add.reduceat(crf.W[np.array(rows)], at[some], axis=0)[:, order]
    return out[which] + _BARRED[[_KINDS[n.kind] for n in nodes]]


def _graph(per_doc: list[list[Node]], skips: bool = True) -> tuple[list[tuple[int, int]], list[int]]:
    """Chain edges (kind 0) and skip edges (1 to 3) of a batch."""
    edges, kinds, at = [], [], 0
    for nodes in per_doc:
        for i in range(len(nodes) - 1):
            if nodes[i].zone == nodes[i + 1].zone:
                edges.append((at + i, at + i + 1))
                kinds.append(0)
        for i, j, k in skip_edges(nodes) if skips else ():
            edges.append((at + i, at + j))
            kinds.append(1 + k)
        at += len(nodes)
    return edges, kinds


def label_documents(texts: list[str | None], know: Knowledge) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` pieces of each text."""
    gc.disable()  # nodes hold no cycles, and there are many
    try:
        return _labelled(texts, know)
    finally:
        gc.enable()


def _lone(folded: list[list[str]], units_: list[Node]) -> list[bool]:
    """Runs that no skip edge can reach: none of their words (``folded``) occurs,
    alike or similar, in another place or in a mail address."""
    flat = [k for ks in folded for k in ks]
    mails = {p for n in units_ if n.kind == "email" for p in _locals(n.text)}
    if not mails and len(set(flat)) == len(flat):
        return [True] * len(folded)
    seen: dict[str, int] = {}
    for k in flat:
        seen[k] = seen.get(k, 0) + 1
    return [all([seen[k] == 1 and k not in mails for k in ks]) for ks in folded]


def _labelled(texts: list[str | None], know: Knowledge) -> list[list[tuple[int, int, str]]]:
    """Lone runs are chains of their own, whose names follow from their key:
    those are worked out once a key.  All others meet in one graph."""
    memo, table = _memo(know), _words_told(know, know.given)
    per_doc: list[list[Node]] = []
    named: list[tuple[int, list[tuple[int, int, str]], list[tuple[int, int]]]] = []
    new: dict[Key, list[tuple[int, list[tuple[int, int, str]]]]] = {}
    for d, text in enumerate(texts):
        if not text:
            per_doc.append([])
            continue
        found = units(text, know.shapes)
        nodes = _unit_nodes(text, found)
        runs = list(runs_of(text, [(a, b) for _, a, b in found]))
        told = [[table[w] for _, _, w in words] for words in runs]
        for words, tells, alone in zip(runs, told, _lone([[t[5] for t in tells if t[5] is not None] for tells in told], nodes)):
            key = _run_key(text, words, know, tells)
            if not alone:
                nodes += _run_nodes(words, key, len(nodes))
            elif (spans := memo.get(key)) is None:
                new.setdefault(key, []).append((d, words))
            elif spans:
                named.append((d, words, spans))
        per_doc.append(nodes)
    if new:
        blank = [_run_nodes([(i, i + 1, "") for i in range(len(k[0]))], k, 0) for k in new]
        for (k, at), nodes, labels in zip(new.items(), blank, _infer(blank, know, lonely=True)):
            memo[k] = spans = [(a, b) for a, b, _ in _pieces(nodes, labels, k[0])]
            named += [(d, words, spans) for d, words in at]
    out = [_pieces(nodes, labels) for nodes, labels in zip(per_doc, _infer(per_doc, know))]
    for d, words, spans in named:
        out[d] += [(words[i][0], words[j - 1][1], "name") for i, j in spans]
    for d in {d for d, _, _ in named}:
        out[d].sort()
    return out


def _infer(per_doc: list[list[Node]], know: Knowledge, lonely: bool = False) -> list[list[str]]:
    """Labels by belief propagation over chains and skip edges of all documents."""
    flat = [n for nodes in per_doc for n in nodes]
    if not flat:
        return [[] for _ in per_doc]
    order = [know.crf.labels.index(k) for k in LABELS]
    edges, kinds = _graph(per_doc, not lonely)
    potentials = np.concatenate([know.crf.T[np.ix_(order, order)][None], _AGREE * np.array(know.skip)[:, None, None]])
    belief = propagate(_unary(flat, know.crf, order), np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64), potentials)
    best = [LABELS[k] for k in belief.argmax(1).tolist()]
    out, at = [], 0
    for nodes in per_doc:
        out.append(best[at : at + len(nodes)])
        at += len(nodes)
    return out


_MEMO: dict = {}


def _memo(know: Knowledge) -> dict[Key, list[tuple[int, int]]]:
    """Names in lone runs, as stretches of words, as long as the same knowledge is asked."""
    if _MEMO.get("know") is not know or len(_MEMO["names"]) > 200_000:
        _MEMO.update(know=know, names={})
    return _MEMO["names"]


def _pieces(nodes: list[Node], labels: list[str], shapes: tuple[str, ...] | None = None) -> list[tuple[int, int, str]]:
    """``shapes``: of the words, unless the nodes' texts tell."""
    out = []
    i = 0
    while i < len(nodes):
        if nodes[i].kind != "word" or labels[i] == "O":
            if labels[i] != "O":
                out.append((nodes[i].start, nodes[i].end, _TYPE[labels[i]]))
            i += 1
            continue
        j = i + 1
        while j < len(nodes) and nodes[j].zone == nodes[i].zone and labels[j] == "I":
            j += 1
        if is_full_name(list(shapes[i:j]) if shapes else [_shape(n.text) for n in nodes[i:j]]):
            out.append((nodes[i].start, nodes[j - 1].end, "name"))
        i = j
    return sorted(out)


_FULL = re.compile(r"(?:(?:N|I)(?: ?(?:N|I))*(?: P)* N|C , N(?: (?:N|I))*)")


def is_full_name(shapes: list[str]) -> bool:
    """Exact check: given names or initials, particles, a family name; or a
    family name in capitals, a comma and given names."""
    code = {"cap": "N", "double": "N", "mixed": "N", "caps": "N", "initial": "I", "particle": "P", ",": ","}
    s = " ".join(code.get(x, "x") for x in shapes)
    if shapes[:1] in (["caps"], ["double"]) and shapes[1:2] == [","]:
        s = "C" + s[1:]
    return _FULL.fullmatch(s) is not None


# --- counts over all rows -----------------------------------------------------------


def _tag_counts(rows: Iterable[tuple[list[str | None], list[str | None]]]) -> dict[tuple[str, str], list[int]]:
    """Of tagged rows: capitalised words (``g``), as the first word of a tagged
    person and in all; shapes of numbers (``s``), tagged as telephone and in
    all; ``("", kind)`` the sums."""
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    capitals: list[str] = []
    firsts: list[str] = []
    for tokens, tags in rows:
        first = set()
        none = tags.count("O") == len(tags)
        i = len(tags) if none else 0
        while i < len(tags):
            tag, j = tags[i] or "O", i + 1
            while j < len(tags) and tag[:2] == "B-" and tags[j] == "I-" + tag[2:]:
                j += 1
            if tag == "B-PER" and j > i + 1:
                first.add(i + 2 if tokens[i + 1] == "," and i + 2 < len(tokens) else i)
            elif tag in ("B-TEL", "B-FAX"):
                n = out["s", number_shape(" ".join(t or "" for t in tokens[i:j]))]
                n[0] += 1
                n[1] += 1
                out["s", ""][0] += 1
            i = j
        rest = " ".join([t or "" for t in tokens]) if none else " ".join((t or "") if g is None or g[2:] not in ("TEL", "FAX") else "|" for t, g in zip(tokens, tags))
        for m in DIGITS.finditer(rest):
            if m.end() - m.start() > 5 and sum(c.isdigit() for c in m.group()) > 5:
                front = _FRONT.search(rest, max(0, m.start() - 7), m.start())
                out["s", number_shape(rest[front.start() if front else m.start() : m.end()])][1] += 1
        capitals += [t for t in tokens if t and t[0].isupper()]
        firsts += [tokens[i] for i in first if tokens[i]]
        out["g", ""][0] += len(first)
    begun = Counter(firsts)
    for token, count in Counter(capitals).items():
        for part in token.split("-"):
            if part[:1].isupper() and part.isalpha() and len(part) > 2 and not part.isupper():
                n = out["g", part]
                n[0] += begun[token]
                n[1] += count
    return out


#: A given name or a shape has at least this share of its kind: at most so many.
LEAST_SHARE = 1e-5


def _context_counts(texts: list[str | None], know: Knowledge) -> dict[tuple[str, str], list[int]]:
    gc.disable()
    try:
        return _contexts_counted(texts, know)
    finally:
        gc.enable()


def _contexts_counted(texts: list[str | None], know: Knowledge) -> dict[tuple[str, str], list[int]]:
    words_: list[str] = []
    contexts: list[str] = []
    hits: list[str] = []
    n_runs = n_known = 0
    table = _words_told(know, know.given)
    for t in texts:
        if not t:
            continue
        for words in runs_of(t, []):
            shapes, known, _, lows, _, _ = zip(*[table[w] for _, _, w in words])
            before = [*_outside(t, words[0][0]), *lows]
            words_ += before[2:]
            if m := _AFTER.match(t, words[-1][1]):
                words_.append(m.group(1).lower())
            n_runs += 1
            for i, hit in _starts(shapes, known):
                l1, l2, l3 = _contexts(before, i)
                # behind a sign the word before it tells more than behind a word
                keys = (l1, l2) if l1[:1].isalpha() else (l1, l2, l3)
                contexts += keys
                if hit:
                    hits += keys
                    n_known += 1
    out: dict[tuple[str, str], list[int]] = {("w", w): [0, n] for w, n in Counter(words_).items() if w[:1].isalpha()}
    hit_counts = Counter(hits)
    out.update((("c", k), [hit_counts[k], n]) for k, n in Counter(contexts).items())
    return out | {("w", ""): [n_runs, 0], ("c", ""): [n_known, 0]}


@lru_cache(maxsize=50_000)
def _starts(shapes: tuple[str, ...], known: tuple[bool, ...]) -> list[tuple[int, bool]]:
    """Where in a run a name may begin, and whether with a known given name."""
    return [(i, known[i] or i + 2 < len(shapes) and shapes[i + 1] == "," and known[i + 2]) for i in range(len(shapes) - 1) if _name_length(shapes[i:], known[i:])]


def _kept(counts: dict[tuple[str, str], list[int]], kind: str, share: float, least: float) -> frozenset[str]:
    """Keys whose hits are at least ``share`` of their occurrences and
    ``least`` of all hits."""
    total = counts.get((kind, ""), [0, 0])[0]
    return frozenset(k for (c, k), (hit, n) in counts.items() if c == kind and k and (hit >= max(1, least * total) and hit >= share * n if share else n >= max(OFTEN, least * total)))


# --- training ----------------------------------------------------------------------


def _name_length(shapes: list[str], known: list[bool]) -> int:
    """Words of the name a stretch begins with: first (given or initial), more
    known given names, initials, particles, then one family name."""
    if len(shapes) > 2 and shapes[1] == "," and shapes[2] in ("cap", "double", "caps"):
        return 3
    if not shapes or shapes[0] not in ("cap", "double", "initial", "caps"):
        return 0
    i = 1
    while i < len(shapes) - 1 and known[0] and known[i] and shapes[i] in ("cap", "double"):
        i += 1
    while i < len(shapes) and shapes[i] == "initial":
        i += 1
    while i < len(shapes) and shapes[i] == "particle":
        i += 1
    return i + 1 if i < len(shapes) and shapes[i] in ("cap", "double", "caps", "mixed") else 0


def _silver(text: str, nodes: list[Node], know: Knowledge) -> list[str | None]:
    """Labels of a text's nodes by bootstrapping; None: can't tell, so the node
    teaches nothing."""
    labels: list[str | None] = []
    by_zone: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        if n.kind == "email":
            labels.append("EMAIL" if _SIGN.search(n.text) else None)
        elif n.kind == "street":
            labels.append(None)
        elif n.kind == "number":
            shape = number_shape(n.text)
            if _id_label(text, n.start):
                labels.append("ID")
            elif shape in know.shapes or PHONE_LABEL.search(text, max(0, n.start - 40), n.start):
                labels.append("PHONE")
            else:
                labels.append(None if re.match(r"\+ ?\d|\(?0\d{1,4}\)?[ /]\d", n.text) else "O")
        else:
            by_zone[n.zone].append(i)
            labels.append("O")
    for members in by_zone.values():
        words = [(nodes[i].start, nodes[i].end, nodes[i].text) for i in members]
        shapes, flags = [_shape(w) for _, _, w in words], _known(words, know.given)
        lows = [_plain(w).lower().rstrip(".") for _, _, w in words]
        outside = _outside(text, words[0][0])
        i = 0
        while i < len(words) - 1:
            k = _name_length(shapes[i:], flags[i:])
            known = flags[i] or k == 3 and shapes[i + 1] == "," and flags[i + 2]
            if k and not known:
                known = any(c in know.contexts for c in _contexts([*outside, *lows], i)) and (shapes[i] == "initial" or lows[i] not in know.frequent and lows[i] not in know.contexts) and lows[i + k - 1] not in know.frequent
            if k and known:
                for x in members[i : i + k]:
                    labels[x] = "I"
                labels[members[i]] = "B"
                i += k
                continue
            if k and shapes[i] == "initial":
                for x in members[i : i + k]:
                    labels[x] = None
            i += 1
    return labels


def _tagged(nodes: list[Node], spans: list[tuple[int, int, str]]) -> list[str | None]:
    """Labels of a tagged text's nodes from the tags of the tokens they cover."""
    kind = {"TEL": "PHONE", "FAX": "PHONE", "EMAIL": "EMAIL", "STREET": "STREET"}
    labels: list[str | None] = []
    for n in nodes:
        tags = [g for a, b, g in spans if a < n.end and n.start < b]
        if n.kind == "word":
            labels.append("B" if tags[:1] == ["B-PER"] else "I" if tags[:1] == ["I-PER"] else "O")
            continue
        types = {kind.get(g[2:], "O") for g in tags}
        want = {"email": "EMAIL", "street": "STREET", "number": "PHONE"}[n.kind]
        whole = tags[:1] and tags[0][:2] == "B-" and all(g[:2] == "I-" for g in tags[1:])
        labels.append(want if types == {want} and whole else "O" if want not in types else None)
    return labels


def fit(blocks: list[tuple[list[str], list[str]]], documents: list[str], iterations: int = 30, know: Knowledge | None = None) -> Knowledge:
    """Weights from blocks and documents; what is counted over all rows too,
    unless it comes in ``know``."""
    if know is None:
        tags = _tag_counts(blocks)
        know = Knowledge(given=_kept(tags, "g", GIVEN_SHARE, LEAST_SHARE), shapes=_kept(tags, "s", SHAPE_SHARE, LEAST_SHARE))
        _with_contexts(know, _context_counts(documents, know))
    X: list[list[list[str]]] = []
    y: list[list[str]] = []
    hidden: list[tuple[list[Node], list[str | None]]] = []

    def add(nodes: list[Node], labels: list[str | None]) -> None:
        at: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(nodes):
            at[n.zone].append(i)
        for members in at.values():
            told = [labels[i] for i in members]
            if None not in told:
                X.append([nodes[i].features for i in members])
                y.append(told)

    none: frozenset[str] = frozenset()
    for text in documents:
        nodes = zones(text, know)
        labels = _silver(text, nodes, know)
        add(nodes, labels)
        # the same once more with given names hidden: for names that no list holds
        bare = zones(text, know, none)
        hidden.append((bare, labels))
        if "B" in labels:
            add([n for n in bare if n.kind == "word"], [k for n, k in zip(bare, labels) if n.kind == "word"])
    for tokens, tags in blocks:
        text, at, spans = " ".join(tokens), 0, []
        for t, g in zip(tokens, tags):
            spans.append((at, at + len(t), g or "O"))
            at += len(t) + 1
        for given in (know.given, none):
            nodes = zones(text, know, given)
            add(nodes, _tagged(nodes, spans))
    # every label is known even if the sample lacks it
    for kind, label in (("email", "EMAIL"), ("street", "STREET"), ("number", "PHONE"), ("number", "ID"), ("word", "B"), ("word", "I"), ("word", "O")):
        X.append([[f"kind={kind}"]])
        y.append([label])
    know.crf = LinearChainCRF(c1=0.0, c2=0.05, max_iterations=iterations, tolerance=1e-4).fit(X, y)
    know.skip = _fit_skip(hidden, know)
    return know


def _fit_skip(docs: list[tuple[list[Node], list[str | None]]], know: Knowledge, penalty: float = 1.0) -> tuple[float, float, float]:
    """The skip potentials by pseudo-likelihood: each end's label given the
    other's and its own chain's belief; one convex problem a kind, by Newton."""
    order = [know.crf.labels.index(k) for k in LABELS]
    per_doc = [nodes for nodes, _ in docs]
    flat = [n for nodes in per_doc for n in nodes]
    if not flat:
        return 0.0, 0.0, 0.0
    edges, kinds = _graph(per_doc)
    code = {k: i for i, k in enumerate(LABELS)}
    gold = np.array([code.get(k, -1) for _, labels in docs for k in labels])
    e, k = np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)
    chain = k == 0
    belief = propagate(_unary(flat, know.crf, order), e[chain], k[chain], know.crf.T[np.ix_(order, order)][None])
    out = []
    for kind in (1, 2, 3):
        pairs = e[(k == kind) & (gold[e] >= 0).all(1)] if len(e) else e
        A = _AGREE[kind - 1]
        A = np.maximum(A, A.T)
        a, b = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        agree, theta = A[:, gold[b]].T, 0.0
        for _ in range(30 if len(a) else 0):
            z = belief[a] + theta * agree
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            mean = (p * agree).sum(1)
            slope = (agree[np.arange(len(a)), gold[a]] - mean).sum() - penalty * theta
            step = slope / ((p * agree**2).sum(1) - mean**2 + 1e-9).sum().clip(penalty)
            theta = float(np.clip(theta + np.clip(step, -1, 1), 0.0, 6.0))
            if abs(step) < 1e-4:
                break
        out.append(theta)
    return tuple(out)


def _with_contexts(know: Knowledge, counts: dict[tuple[str, str], list[int]]) -> None:
    know.contexts, know._ends = _kept(counts, "c", CONTEXT_SHARE, CONTEXT_LEAST), None
    know.frequent = _kept(counts, "w", 0, FREQUENT_SHARE)


def _counted(df: DataFrame, count, share: dict[str, float], least: float | dict[str, float]) -> dict[tuple[str, str], list[int]]:  # noqa: ANN001
    """Counts of all rows, summed; only keys that may be kept reach the driver,
    at most ``1 / least`` times the keys of one occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}

        def summed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in total], pa.string()) for j in (0, 1)], *[pa.array([n[j] for n in total.values()], pa.int64()) for j in (0, 1)]], ["kind", "key", "hit", "n"])
            total.clear()
            return out

        for batch in batches:
            for k, n in count(batch).items():
                if (m := total.get(k)) is None:
                    total[k] = n
                else:
                    m[0] += n[0]
                    m[1] += n[1]
            if len(total) > 300_000:
                yield summed()
        yield summed()

    sums = df.mapInArrow(run, "kind string, key string, hit long, n long").groupBy("kind", "key").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).persist()
    try:
        totals = {r.kind: r.hit for r in sums.where("key = ''").collect()}
        wanted = F.lit(False)
        for kind, part in share.items():
            floor = (least[kind] if isinstance(least, dict) else least) * totals.get(kind, 0)
            wanted = wanted | (F.col("kind") == kind) & ((F.col("hit") >= max(1.0, floor)) & (F.col("hit") >= part * F.col("n")) if part else F.col("n") >= max(OFTEN, floor))
        rows = sums.where((F.col("key") != "") & wanted).collect()
        return {**{(k, ""): [n, 0] for k, n in totals.items()}, **{(r.kind, r.key): [r.hit, r.n] for r in rows}}
    finally:
        sums.unpersist()


def _sample(df: DataFrame, ident: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest hash.  A cut of the hash that leaves about
    ``2 n`` rows is taken first, so that tasks send no more than that."""
    total = df.select(ident).count()
    h = F.xxhash64(F.col(ident).cast("string"))
    kept = df.where(h < F.lit(int(-(2**63) + 2**64 * min(1.0, 2 * n / total))).cast("long")) if total > 2 * n else df
    return kept.withColumn("__h", h).orderBy("__h").limit(n)


def _lists(column: pa.Array) -> list[list]:
    """A column of lists of strings, without nulls, by its flat values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _pairs(batch: pa.RecordBatch) -> list[tuple[list, list]]:
    return [(t, g) for t, g in zip(_lists(batch.column(0)), _lists(batch.column(1))) if len(t) == len(g)]


def train(documents: DataFrame, doc_id: str, text: str, blocks: DataFrame | None = None, block_id: str = "block_id", sample_documents: int = SAMPLE_DOCUMENTS, sample_blocks: int = SAMPLE_BLOCKS, sample_chars: int = SAMPLE_CHARS) -> Knowledge:
    """Given names, shapes, contexts and frequent words of all rows; weights
    from at most ``sample_documents`` texts and ``sample_blocks`` tagged blocks
    of at most ``sample_chars`` characters each, chosen by hash."""
    know = Knowledge()
    tagged: list[tuple[list[str], list[str]]] = []
    if blocks is not None:
        blocks = blocks.select(block_id, "tokens", "tags").where("tokens IS NOT NULL AND tags IS NOT NULL AND size(tokens) > 0")
        tags = _counted(blocks.select("tokens", "tags"), lambda b: _tag_counts(_pairs(b)), {"g": GIVEN_SHARE, "s": SHAPE_SHARE}, LEAST_SHARE)
        know.given, know.shapes = _kept(tags, "g", GIVEN_SHARE, LEAST_SHARE), _kept(tags, "s", SHAPE_SHARE, LEAST_SHARE)
        rows = _sample(blocks.where(F.array_contains("tags", "B-PER") | F.array_contains("tags", "B-TEL") | F.array_contains("tags", "B-EMAIL") | F.array_contains("tags", "B-STREET") | (F.pmod(F.xxhash64(block_id), F.lit(4)) == 0)), block_id, sample_blocks)
        rows = rows.where(F.length(F.concat_ws(" ", "tokens")) <= sample_chars).select("tokens", "tags")
        tagged = [(list(r.tokens), list(r.tags)) for r in rows.collect() if None not in r.tokens and len(r.tokens) == len(r.tags)]
    texts = documents.select(doc_id, text).where(F.length(text) > 0)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(know)  # at most 1 / LEAST_SHARE names and shapes
    _with_contexts(know, _counted(texts.select(text), lambda b: _context_counts(b.column(0).to_pylist(), shared.value), {"c": CONTEXT_SHARE, "w": 0}, {"c": CONTEXT_LEAST, "w": FREQUENT_SHARE}))
    sample = [r[0] for r in _sample(texts.where(F.length(text) <= sample_chars), doc_id, sample_documents).select(text).collect()]
    return fit(tagged, sample, know=know)


# --- operators -----------------------------------------------------------------------

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}


def redact(text: str | None, pieces: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in pieces:
        if a >= at:
            parts += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join([*parts, text[at:]])


def _over(df: DataFrame, ident: str, text: str, know: Knowledge, schema: T.StructType, emit) -> DataFrame:  # noqa: ANN001
    shared = df.sparkSession.sparkContext.broadcast(know)  # weights of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                yield emit(part.column(0), texts, label_documents(texts, know), [f.name for f in schema])

    return df.select(ident, text).mapInArrow(run, schema)


def find_rows(df: DataFrame, ident: str, text: str, know: Knowledge) -> DataFrame:
    """``(ident, pii_type, pii_text)``: distinct pieces of each text."""
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField("pii_type", T.StringType()), T.StructField("pii_text", T.StringType())])

    def emit(ids: pa.Array, texts: list, found: list, names: list[str]) -> pa.RecordBatch:
        rows = [(i, *k) for i, (t, p) in enumerate(zip(texts, found)) for k in dict.fromkeys((kind, t[a:b]) for a, b, kind in p)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names)

    return _over(df, ident, text, know, schema, emit)


def redact_rows(df: DataFrame, ident: str, text: str, know: Knowledge, out: str = "redacted") -> DataFrame:
    """``(ident, out, n_pieces)`` of every row."""
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(out, T.StringType()), T.StructField("n_pieces", T.IntegerType())])

    def emit(ids: pa.Array, texts: list, found: list, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([redact(t, p) for t, p in zip(texts, found)], pa.string()), pa.array([len(p) for p in found], pa.int32())], names)

    return _over(df, ident, text, know, schema, emit)
