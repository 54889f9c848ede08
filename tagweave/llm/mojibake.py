"""Texts that were decoded with the wrong character encoding.

Noisy channel.  The source model says how likely a spelling is: the frequency
of the word over *all* given text, backed off to counts of character triples,
pairs and single characters (hashed tables, counted over all text too).  The
channel turns a word's bytes under the right encoding into characters of a
wrong one, or loses them.  Every distinct word that holds anything unusual is
judged once: each explanation proposes an original and has a cost,

* sound: the word as it is; what no correct word holds (a lost byte, a control
  character, a sign between letters ...) makes that explanation dear;
* UTF-8 read as a one-byte encoding: the word's characters are a byte lattice,
  in which a lost byte (U+FFFD, or a code the wrong encoding doesn't have) is a
  wildcard for every character of the corpus whose bytes fit the known ones.  A
  Viterbi search over pairs of characters finds the likeliest path; without
  wildcards a sequence has one reading, so decoding it is the search.  Where a
  reading makes the word likelier it is read again (text damaged repeatedly);
* one-byte text read as another one-byte encoding: a character table;
* damaged beyond repair: the word stays, at a cost.

The best explanation is the verdict.  Word frequencies are joined, not sent
around: proposals are rows (word, proposal, score) that meet the table of the
corpus's words.  Only usual spellings have a frequency, as damage recurs too.

Defined results: null and empty texts are no cases; of repeated rows each is
judged; where a lost byte leaves several originals, the likeliest is given; a
word of which half the characters or more are lost is found and left as it is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.lookalike import normalized
from tagweave.session import fits_broadcast

# Names of encodings.
WRONG = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15"]
PAIRS = [
    *[("cp1252", w) for w in ("mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1253", "cp1254", "cp852", "cp866", "koi8-r", "iso8859-5", "iso8859-7")],
    *[("cp1250", w) for w in ("cp1252", "mac_roman", "cp850", "cp437", "cp1251")],
    *[("mac_roman", w) for w in ("cp1252", "latin-1")],
    *[("cp850", w) for w in ("cp1252", "latin-1")],
    *[("cp437", w) for w in ("cp1252", "latin-1")],
    *[(r, w) for r in ("koi8-r", "cp1251", "iso8859-5", "cp866") for w in ("latin-1", "cp1252", "mac_roman")],
    *[(r, w) for r in ("cp1253", "iso8859-7") for w in ("latin-1", "cp1252", "mac_roman")],
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("latin-1", "cp437"),
    ("latin-1", "cp850"),
]
#: Two tables of so many 64-bit buckets; broadcast, so this is their bound (16 MB).
BUCKETS = 1 << 20
#: Verdicts of damaged words are broadcast up to this size and joined beyond.
BROADCAST_BYTES = 64 << 20
SPLIT = re.compile(r'[ \t\n\r,;|/"、()\[\]{}]+')
_EDGE = "\x02"
_LOST = "�"
_HARD = re.compile(f"[\x80-\x9f{_LOST}]")
#: Channel costs (natural logarithms).
COST_UTF8 = 3.0
COST_TABLE = 7.0
COST_SINGLE = 5.0
COST_CAPITALS = 4.0
COST_SPOOF = 2.0
COST_LOST = 1.0
COST_BEYOND = 30.0
#: What makes the explanation "sound" dear.
COST_HARD = 200.0
COST_BROKEN = 60.0
#: Share of the word frequency in the source model.
WORD_WEIGHT = 0.02


def _table(codec: str) -> dict[int, str]:
    """byte -> character; codes that Windows tables lack stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            if codec.startswith("cp125"):
                out[b] = chr(b)
    return out


@lru_cache(maxsize=1)
def _utf8_channels() -> list[tuple[str, re.Pattern[str], dict[str, int]]]:
    out = []
    for codec in WRONG:
        table = _table(codec)

        def span(a: int, z: int, table: dict[int, str] = table) -> str:
            return "[" + "".join(re.escape(table[b]) for b in range(a, z) if b in table) + "]"

        tail = span(0x80, 0xC0)
        three = f"{tail}{{2}}"
        if codec == "cp866":  # its lower-case letters are both leads and tails, so one tail must be none
            other = span(0x80, 0xA0)[:-1] + span(0xB0, 0xC0)[1:]
            three = f"(?:{other}{tail}|{tail}{other})"
        # leads of Armenian, Hebrew and Syriac are quotes and dashes in Mac tables: left out
        two = span(0xC2, 0xD2)[:-1] + span(0xD7, 0xDB)[1:]
        pattern = f"{two}{tail}|{span(0xE0, 0xF0)}{three}|{span(0xF0, 0xF5)}{tail}{{3}}"
        out.append((codec, re.compile(pattern), {c: b for b, c in table.items()}))
    return out


@lru_cache(maxsize=1)
def _any_utf8() -> re.Pattern[str]:
    return re.compile("|".join(p.pattern for _, p, _ in _utf8_channels()))


@lru_cache(maxsize=1)
def _tables() -> list[tuple[str, dict[int, str]]]:
    out = []
    for right, wrong in PAIRS:
        seen, want = _table(wrong), _table(right)
        table = {ord(c): want[b] for b, c in seen.items() if b in want and want[b] != c and not _HARD.match(want[b]) and want[b].isprintable()}
        out.append((f"{right}>{wrong}", table))
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer((_EDGE + _EDGE + (_EDGE + _EDGE).join(words) + _EDGE + _EDGE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash(*codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket in each of the two tables."""
    h = np.full(len(codes[0]), len(codes) + 1, np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    mask = np.uint64(BUCKETS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + BUCKETS


def count_words(words: list[str]) -> np.ndarray:
    """Counts of triples, pairs and characters in the hashed tables."""
    out = np.zeros(2 * BUCKETS, np.int64)
    for at, n in _grams(words):
        out[at] += n
    return out


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, counts)`` of a batch of words."""
    c = _codes(words)
    if words and len(c) > 2:
        for grams in ((c[:-2], c[1:-1], c[2:]), (c[:-1], c[1:]), (c,)):
            for h in _hash(*grams):
                yield np.unique(h, return_counts=True)


class SourceModel:
    """Likelihood of spellings, from hashed counts of all text.  A count is the
    smaller of its two buckets, less what other entries put there on average."""

    def __init__(self, counts: np.ndarray) -> None:
        self.total = max(1.0, counts.sum() / 6)
        self.counts = counts
        self.noise = np.array([counts[:BUCKETS].sum(), counts[BUCKETS:].sum()]) / max(1, BUCKETS - 1)

    def count(self, *codes: np.ndarray) -> np.ndarray:
        a, b = _hash(*codes)
        a, b = self.counts[a], self.counts[b]
        n = np.minimum(a - (self.noise[0] - a / BUCKETS), b - (self.noise[1] - b / BUCKETS))
        return np.maximum(n, 0.0)

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log P(c | a, b)."""
        p1 = (self.count(c) + 0.02) / (self.total + 2000)
        p2 = (self.count(b, c) + 2 * p1) / (self.count(b) + 2)
        p3 = (self.count(a, b, c) + 2 * p2) / (self.count(a, b) + 2)
        return np.log(np.minimum(1.0, p3))

    def scores(self, words: list[str]) -> np.ndarray:
        """log P of spellings; words in capitals count as in small letters."""
        if not words:
            return np.zeros(0)
        plain = [w.lower() if len(w) > 3 and w.isupper() else w for w in words]
        c = _codes(plain)
        each = self.logs(c[:-2], c[1:-1], c[2:])
        lengths = np.array([len(w) for w in plain]) + 2  # two edges between words belong to both
        ends = np.cumsum(lengths)
        total = np.r_[0, np.cumsum(each)]
        return total[ends] - total[ends - lengths]

    @lru_cache(maxsize=1)  # noqa: B019
    def letters(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Code points, scripts and UTF-8 bytes (n, 4) of the corpus's characters beyond ASCII."""
        every = np.r_[0xA1:0xD800, 0xF900:0xFE00, 0xFE30:0xFFFD, 0x10300:0x10400, 0x1F300:0x1FAFF, 0x20000:0x2A6E0].astype(np.uint64)
        found = [int(c) for c in every[self.count(every) > max(2.0, 2e-7 * self.total)] if chr(int(c)).isprintable()]
        raw = np.zeros((len(found), 4), np.int64)
        for i, c in enumerate(found):
            b = chr(c).encode()
            raw[i, : len(b)] = list(b)
        return np.array(found, np.uint64), [_script(chr(c)) for c in found], raw


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


_ODD = "†‡ˆ˚¯´±§¶³‰˝˛˜¨¸¬¤¦¥÷×√≈∞∏∂∑∫◊¡─-▓"
#: What no correct word holds: a sign between letters, a capital with an accent
#: after a small letter or between a capital and a small one, four accented
#: Latin letters in a row, a small Cyrillic letter before capitals, Latin with
#: letters of another script that don't look Latin.
_BROKEN = re.compile(
    f"[^\\W\\d_][{_ODD}][^\\W\\d_]|[^\\W\\d_][„‚›‹»«][a-zß-ÿ]|[a-zß-ÿ][À-ÖØ-ÞŠŸŽŒ]"
    "|(?<![^\\W\\d_])[A-Z][À-ÖØ-Þ][a-z]|[À-ÿ]{4,}|(?<![^\\W\\d_])[а-яё][А-ЯЁ]{2,}"
    "|[A-Za-zÀ-ɏ][бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯαβγδεζηθλμξπσςτυφχψωΓΔΘΛΞΠΣΦΨΩ]|[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюяΓΔΘΛΞΠΣΦΨΩβγδεζηθλμξπσςτφχψω][A-Za-zÀ-ɏ]"
)
_INNER = re.compile(f"[A-ZÀ-Þ][À-ÞŠŸŽ][a-z]|[^\\W\\d_][{_ODD}]|[{_ODD}][^\\W\\d_]")


class Repairer:
    """Judges words."""

    def __init__(self, model: SourceModel, spoofed: bool = True) -> None:
        self.model, self.spoofed = model, spoofed
        self.usuals: dict[str, bool] = {}

    @lru_cache(maxsize=100_000)  # noqa: B019
    def common(self, c: str) -> bool:
        return bool(self.model.count(np.array([ord(c)], np.uint64))[0] > 4e-6 * self.model.total)

    def unusual(self, word: str) -> bool:
        """A cheap test that all damaged words pass."""
        if _HARD.search(word) or _any_utf8().search(word) or _INNER.search(word) or _BROKEN.search(word):
            return True
        body = word.strip("'’.:-!?")
        if len(body) == 1 or not body:
            return True
        latin = sum("A" <= c <= "ɏ" for c in body)
        high = [c for c in body if c > "\x7f"]
        strange = sum(c > "ɏ" and c.isalpha() and not ("Ḁ" <= c <= "ỿ") for c in body)
        return bool(strange and latin) or len(high) * 2 > len(body) and latin * 2 > len(body) or "ß" in body or not all(self.common(c) for c in high)

    def explanations(self, words: list[str]) -> list[tuple[float, list[tuple[str, float, float, bool]]]]:
        """Of each word its score as sound, and the other explanations:
        ``(original, log P of its spelling, channel cost, usual spelling)``."""
        layers: list[dict[str, float]] = [{w: 0.0} for w in words]
        found: list[dict[str, float]] = [{} for _ in words]
        own = dict(zip(words, self.model.scores(words)))
        known = dict(own)
        live = list(range(len(words)))
        while live:
            fresh: list[dict[str, float]] = [self._read(layers[i]) for i in live]
            new = list({t for f in fresh for t in f} - known.keys())
            known.update(zip(new, self.model.scores(new)))
            following = []
            for i, f in zip(live, fresh):
                before = max(known[t] for t in layers[i])
                f = {t: c for t, c in f.items() if t != words[i] and c < found[i].get(t, math.inf)}
                found[i].update(f)
                # read on where the reading made the word likelier
                layers[i] = {t: c for t, c in f.items() if known[t] > before}
                if layers[i]:
                    following.append(i)
            live = following
        for i, w in enumerate(words):
            # a reading that leaves something unusual isn't the whole explanation
            if _LOST not in w and all(self._unusual(t) for t in found[i]):
                for t, c in self._tables(w).items():
                    found[i][t] = min(c, found[i].get(t, math.inf))
        new = list({t for f in found for t in f} - known.keys())
        known.update(zip(new, self.model.scores(new)))
        out = []
        for w, f in zip(words, found):
            spoof = self.spoofed and not _HARD.search(w) and not _BROKEN.search(w) and _is_spoof(w)
            sound, usual = own[w], [(t, known[t], c, not spoof and not self._unusual(t)) for t, c in f.items()]
            if spoof:
                # letters that look Latin were put in on purpose
                sound = max(sound, float(self.model.scores(normalized(w).split()).sum()) - COST_SPOOF)
            if _HARD.search(w):
                sound -= COST_HARD
            elif _BROKEN.search(w) or not self.spoofed and _mixed(w):
                sound -= COST_BROKEN
            out.append((sound, [*usual, (w, own[w], COST_BEYOND, False)]))
        return out

    def _unusual(self, word: str) -> bool:
        got = self.usuals.get(word)
        if got is None:
            if len(self.usuals) > 300_000:
                self.usuals.clear()
            got = self.usuals[word] = not word.isascii() and self.unusual(word)
        return got

    def judge(self, word: str, frequency: dict[str, float] | None = None) -> tuple[bool, str]:
        """Verdict on one word; ``frequency``: shares of usual words."""
        if word.isascii() or not self.unusual(word):
            return False, word
        sound, others = self.explanations([word])[0]
        share = lambda t, usual: (frequency or {}).get(t, 0.0) if usual else 0.0
        score, back = max((math.log(WORD_WEIGHT * share(t, u) + (1 - WORD_WEIGHT) * math.exp(p) + 1e-300) - c if p > -600 else p - c, t) for t, p, c, u in others)
        return (True, back) if score > sound else (False, word)

    def _read(self, layer: dict[str, float]) -> dict[str, float]:
        """Readings of texts as UTF-8, with their costs."""
        out: dict[str, float] = {}
        for text, cost in layer.items():
            if _LOST in text:
                if 2 * text.count(_LOST) >= len(text):
                    continue
                for bytes_of in (None, *(b for _, _, b in _utf8_channels())):
                    got = self._path(text, bytes_of)
                    if got and got != text:
                        c = cost + COST_LOST * text.count(_LOST) + (COST_UTF8 if bytes_of else 0.0)
                        out[got] = min(c, out.get(got, math.inf))
                continue
            for _, pattern, bytes_of in _utf8_channels():
                if pattern.search(text):
                    got = pattern.sub(lambda m: _decoded(m.group(), bytes_of), text)  # noqa: B023
                    if got != text:
                        out[got] = min(cost + COST_UTF8, out.get(got, math.inf))
        return out

    def _tables(self, word: str) -> dict[str, float]:
        """The word's originals under one-byte tables, with their costs."""
        if len(word) == 1 and (word.isupper() or not word.isalpha() and self.common(word)):
            return {}  # an initial, a sign of the corpus
        out: dict[str, float] = {}
        base = COST_SINGLE if len(word) == 1 else COST_TABLE
        if word.isupper() and len(word) > 3 and word[0] < "Ͱ" and not _BROKEN.search(word):
            base += COST_CAPITALS
        homoglyph = self.spoofed and _is_spoof(word)
        for _, table in _tables():
            got = word.translate(table)
            if got != word and not (homoglyph and got.isascii()):
                moved = sum(a != b for a, b in zip(word, got))
                # a whole word in another script is one event, single letters are several
                out[got] = min(base - min(4, moved - 1), out.get(got, math.inf))
        return out

    def _path(self, text: str, bytes_of: dict[str, int] | None) -> str | None:
        """Viterbi search over the byte lattice of ``text``: the likeliest
        reading, states are pairs of characters.  Without a channel only lost
        characters are filled."""
        codes, scripts, raw = self.model.letters()
        of_word = {_script(c) for c in text if c.isalpha()} or {"LATIN"}
        fill = codes[[i for i, s in enumerate(scripts) if s in of_word or not s]]
        n = len(text)
        ahead: list[list[tuple[int, np.ndarray]]] = []
        joined = False
        for i, c in enumerate(text):
            moves = [(1, fill if c == _LOST else np.array([ord(c)], np.uint64))]
            if bytes_of is not None:
                for k in (2, 3, 4):
                    got = _fitting(text[i : i + k], k, bytes_of, codes, raw)
                    if len(got):
                        moves.append((k, got))
                        joined = True
            ahead.append(moves)
        if bytes_of is not None and not joined:
            return None
        edge = np.array([ord(_EDGE)], np.uint64)
        # per place: states (a, b), scores, and where each came from
        places: list[list] = [[] for _ in range(n + 1)]
        places[0] = [(edge, edge, np.zeros(1), np.array([-1]), np.array([-1]))]
        settled: list[tuple | None] = [None] * (n + 1)
        for i in range(n + 1):
            if not places[i]:
                continue
            A, B, S, P, Q = (np.concatenate([x[k] for x in places[i]]) for k in range(5))
            order = np.lexsort((-S, B, A))
            A, B, S, P, Q = A[order], B[order], S[order], P[order], Q[order]
            first = np.r_[True, (A[1:] != A[:-1]) | (B[1:] != B[:-1])]
            A, B, S, P, Q = A[first], B[first], S[first], P[first], Q[first]
            settled[i] = (A, B, S, P, Q)
            if i == n:
                break
            for k, options in ahead[i]:
                if i + k > n or not len(options):
                    continue
                a, b, o = np.repeat(A, len(options)), np.repeat(B, len(options)), np.tile(options, len(A))
                s = np.repeat(S, len(options)) + self.model.logs(a, b, o)
                came = np.repeat(np.arange(len(A)), len(options))
                places[i + k].append((b, o, s, np.full(len(o), i), came))
        if settled[n] is None:
            return None
        A, B, S, P, Q = settled[n]
        last = S + self.model.logs(A, B, np.repeat(edge, len(A)))
        at, k, out = n, int(last.argmax()), []
        while at > 0:
            _, B, _, P, Q = settled[at]
            out.append(chr(int(B[k])))
            at, k = int(P[k]), int(Q[k])
        return "".join(out[::-1])


#: Latin words with letters of other scripts that look Latin: spoofed more often than damaged.
_HOMOGLYPH_ONLY = re.compile(r"[\x00-ɏḀ-ỿ̀-ͯаеорсухіѕјһԁԝӏАВЕЗКМНОРСТУХЅІЈοναικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡ​-‏⁠﻿＀-￯\xadﬀ-ﬆ‐‑−K -   　]*")

_FOREIGN = re.compile("[^\x00-ɏḀ-ỿ̀-ͯ–—‘’“”…ﬀ-ﬆ]")


def _is_spoof(word: str) -> bool:
    """All letters look Latin, and some aren't."""
    return _HOMOGLYPH_ONLY.fullmatch(word) is not None and _FOREIGN.search(word) is not None


_MIXED = re.compile("[A-Za-zÀ-ɏ].*[Ͱ-ӿ]|[Ͱ-ӿ].*[A-Za-zÀ-ɏ]")


def _mixed(word: str) -> bool:
    """Latin and Cyrillic or Greek letters in one word."""
    return _MIXED.search(word) is not None


def trusted(text: str | None) -> list[str]:
    """The words of a text that count for the source model: none of texts with
    hard evidence of damage, and none that mix scripts."""
    if not text:
        return []
    if text.isascii():
        return [w for w in SPLIT.split(text) if w]
    if _HARD.search(text) or _any_utf8().search(text):
        return []
    return [w for w in SPLIT.split(text) if w and (w.isascii() or not _mixed(w))]


def _decoded(s: str, bytes_of: dict[str, int]) -> str:
    try:
        return bytes(bytes_of[c] for c in s).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return s




def _fitting(s: str, n: int, bytes_of: dict[str, int], codes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Corpus characters of ``n`` UTF-8 bytes that fit the bytes of ``s``; lost
    ones are free, but one must be known."""
    if len(s) < n:
        return codes[:0]
    known = [None if c == _LOST else bytes_of.get(c, -1) for c in s]
    if -1 in known or known.count(None) == n or known[0] is not None and not _LEAD[n][0] <= known[0] < _LEAD[n][1] or any(k is not None and not 0x80 <= k < 0xC0 for k in known[1:]):
        return codes[:0]
    if None not in known:
        try:
            c = bytes(known).decode()
        except UnicodeDecodeError:
            return codes[:0]
        return np.array([ord(c)], np.uint64) if c.isprintable() else codes[:0]
    fits = (raw[:, n - 1] > 0) & (raw[:, n] == 0 if n < 4 else True)
    for j, k in enumerate(known):
        if k is not None:
            fits &= raw[:, j] == k
    return codes[fits]


_LEAD = {2: (0xC2, 0xE0), 3: (0xE0, 0xF0), 4: (0xF0, 0xF5)}


def _texts_of(column: pa.Array) -> list[str | None]:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return [None if t is None else " ".join(x for x in t if x) for t in column.to_pylist()]
    return column.to_pylist()


def survey(sources: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """``(bucket, word, spoofed, n)`` sums over every row of ``(table, column,
    kind)``: hashed gram counts of trusted text (``bucket``), and each word
    beyond ASCII with its trusted occurrences.  ``kind`` says how the column is
    judged: "spoofed" if letters of other scripts that look Latin occur for
    other reasons than damage, "plain", or None if it is only counted."""
    parts = []
    for df, column, kind in sources:

        def run(batches: Iterator[pa.RecordBatch], kind: str | None = kind) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            seen: dict[str, int] = {}

            def words_out() -> pa.RecordBatch:
                n = len(seen)
                out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(list(seen), pa.string()), pa.array([kind] * n, pa.string()), pa.array(list(seen.values()), pa.int64())], ["bucket", "word", "kind", "n"])
                seen.clear()
                return out

            for batch in batches:
                total = np.zeros(2 * BUCKETS, np.int64) if total is None else total
                good: list[str] = []
                for text in _texts_of(batch.column(0)):
                    if not text:
                        continue
                    words = trusted(text)
                    good += words
                    if not text.isascii():
                        for w in words:
                            if not w.isascii():
                                seen[w] = seen.get(w, 0) + 1
                        for w in SPLIT.split(text):
                            if w and not w.isascii():
                                seen.setdefault(w, 0)
                for at, n in _grams(good):
                    total[at] += n
                if len(seen) > 100_000:
                    yield words_out()
            if total is not None:
                at = np.flatnonzero(total)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(total[at])], ["bucket", "word", "kind", "n"])
            yield words_out()

        parts.append(df.select(F.col(column).alias("x")).mapInArrow(run, "bucket int, word string, kind string, n long"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("bucket", "word", "kind").agg(F.sum("n").alias("n"))


def gram_counts(surveyed: DataFrame) -> np.ndarray:
    """The hashed tables: the driver gets one number a bucket."""
    out = np.zeros(2 * BUCKETS, np.int64)
    got = surveyed.where("bucket IS NOT NULL").select("bucket", "n").toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _repairer(counts: np.ndarray, spoofed: bool) -> Repairer:
    if _STATE.get("counts") is not counts:
        _STATE.clear()
        _STATE.update(counts=counts, model=SourceModel(counts))
    if spoofed not in _STATE:
        _STATE[spoofed] = Repairer(_STATE["model"], spoofed)
    return _STATE[spoofed]


_STATE: dict = {}


def verdicts(sources: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """``(word, kind, back)``: every damaged word of the judged columns and its
    original.  Words are judged once each, by the tables of all sources."""
    surveyed = survey(sources).persist(StorageLevel.MEMORY_AND_DISK)
    spark = surveyed.sparkSession
    shared = spark.sparkContext.broadcast(gram_counts(surveyed))  # fixed size: 2 * BUCKETS numbers
    words = surveyed.where("word IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows: list[tuple] = []
                pairs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                for kind in ("plain", "spoofed"):
                    repairer = _repairer(shared.value, kind == "spoofed")
                    mine = [w for w, k in pairs if k == kind and repairer.unusual(w)]
                    for w, (sound, others) in zip(mine, repairer.explanations(mine)):
                        rest = max((x for x in others if not x[3]), key=lambda x: x[1] - x[2])
                        rows += [(w, kind, sound, t, p, c, u) for t, p, c, u in [*(x for x in others if x[3]), rest]]
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()))], ["word", "kind", "sound", "back", "p", "cost", "usual"])

    told = words.where("kind IS NOT NULL").select("word", "kind").mapInArrow(run, "word string, kind string, sound double, back string, p double, cost double, usual boolean")
    total = words.agg(F.sum("n")).first()[0] or 0
    share = words.groupBy(F.col("word").alias("back")).agg((F.sum("n") / F.lit(float(max(1, total)))).alias("share"))
    usual = F.when(F.col("usual"), F.coalesce("share", F.lit(0.0))).otherwise(0.0)
    score = F.when(F.col("p") > -600, F.log(WORD_WEIGHT * usual + (1 - WORD_WEIGHT) * F.exp("p") + F.lit(1e-300))).otherwise(F.col("p")) - F.col("cost")
    best = told.join(share, "back", "left").withColumn("score", score).groupBy("word", "kind").agg(F.max_by("back", F.struct("score", "back")).alias("back"), F.max("score").alias("score"), F.first("sound").alias("sound"))
    return best.where("score > sound").select("word", "kind", "back")


def damaged(df: DataFrame, ident: str, column: str, told: DataFrame, kind: str, restored: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(ident)`` of the rows with a damaged word of ``told`` (see
    :func:`verdicts`); with ``restored`` also the text with its damaged words
    replaced (tokens joined by single spaces).  The verdicts are broadcast if
    they are counted below ``broadcast_bytes``; beyond, texts meet them by word."""
    told = told.where(F.col("kind") == kind).select("word", "back")
    fields = [T.StructField(ident, df.schema[ident].dataType)] + ([T.StructField(restored, T.StringType())] if restored else [])
    if not fits_broadcast(told, broadcast_bytes):
        return _damaged_joined(df, ident, column, told, restored)
    shared = df.sparkSession.sparkContext.broadcast({r.word: r.back for r in told.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = shared.value
        for batch in batches:
            hit, texts = [], []
            for i, text in enumerate(_texts_of(batch.column(1))):
                if text and not text.isascii() and any(w in bad for w in SPLIT.split(text)):
                    hit.append(i)
                    if restored:
                        texts.append(_replaced(text, bad))
            columns = [batch.column(0).take(pa.array(hit, pa.int64()))] + ([pa.array(texts, pa.string())] if restored else [])
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return df.select(ident, column).mapInArrow(run, T.StructType(fields))


def _replaced(text: str, bad: dict[str, str]) -> str:
    return "".join(bad.get(w, w) for w in re.split(f"({SPLIT.pattern})", text))


def _damaged_joined(df: DataFrame, ident: str, column: str, told: DataFrame, restored: str | None) -> DataFrame:
    """For verdicts without a proven size: the distinct texts' words meet them."""
    text = F.concat_ws(" ", F.filter(column, lambda x: x != "")) if isinstance(df.schema[column].dataType, T.ArrayType) else F.col(column)
    rows = df.select(F.col(ident).alias("i"), F.when(F.col(column).isNotNull(), text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = sorted({w for w in SPLIT.split(t) if not w.isascii()})
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(words), pa.string()), pa.array(words, pa.string())], ["t", "word"])

    hits = rows.select("t").distinct().mapInArrow(split, "t string, word string").join(told, "word").groupBy("t").agg(F.collect_list(F.struct("word", "back")).alias("bad"))
    found = rows.join(hits, "t")
    if not restored:
        return found.select(F.col("i").alias(ident))
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(restored, T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_replaced(t, {x["word"]: x["back"] for x in bad}) for t, bad in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ident, restored])

    return found.select("i", "t", "bad").mapInArrow(rewrite, schema)
