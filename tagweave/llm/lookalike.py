"""Names that look like a vocabulary name but are made of other characters.

The vocabulary is a trie; an edge is a visible character with its accents.  A
text walks it as it is written, character by character, with a weighted edit
automaton: reading a look-alike of the edge's character costs nothing
(full-width and other width forms, ligatures, letters of other scripts with the
same shape, any blank for a blank, any hyphen for a hyphen, accents in any
order), neither does a character that can't be seen; any other substitution,
insertion or deletion of a visible character costs one.  With ``budget=0`` only
texts that look the same arrive at a name.  Canonical spelling: the name
arrived at; words that arrive at none are rewritten by the same table.

Within ASCII nothing counts as a look-alike: ``0`` and ``O``, ``1``, ``l`` and
``I`` are told apart in print.  So printable ASCII text is passed over, unless
``budget`` allows edits, blanks stand around it, or a name is itself written
otherwise than it looks.

Defined results: null and empty texts are no cases; a text equal to the name is
none; of repeated rows each is judged; ties between names that look the same
give a row for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagweave.session import fits_broadcast

BROADCAST_BYTES = 32 << 20

# Letters of other scripts, and the Latin letter each looks like.
LOOK_ALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ", "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ẝ",
    "g": "ɡց", "h": "һհ", "i": "іɩι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "սυ",
    "v": "ѵν", "w": "ԝա", "x": "хχ", "y": "уүγ", "z": "ᴢ", "-": "‐‑‒−﹣⁃˗", "'": "ʼ",
}
# Characters without any width or ink beside those of class Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎⁥ㅤﾠ"


def _table() -> dict[str, str]:
    return {c: latin for latin, others in LOOK_ALIKES.items() for c in others}


_LOOKS = _table()


class _Forms(dict):
    """character -> what it looks like: decomposed, '' if it can't be seen."""

    def __missing__(self, c: str) -> str:
        if unicodedata.category(c) == "Cf" or c in UNSEEN or "︀" <= c <= "️" or c >= "\U000e0000" and c <= "\U000e01ef":
            out = ""
        elif unicodedata.category(c) == "Zs" or c in "\t\n\r\v\f":
            out = " "
        else:
            wide = unicodedata.normalize("NFKC", c)
            wide = c if " " in wide else wide
            out = "".join(_LOOKS.get(x, x) for x in unicodedata.normalize("NFD", wide))
        self[c] = out
        return out


FORMS = _Forms()
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]{2,}")


def _ordered(s: str) -> str:
    return _MARKS.sub(lambda m: "".join(sorted(m.group(), key=unicodedata.combining)), s)


def skeleton(s: str) -> str:
    """The look of a text: equal for texts that look the same."""
    return _ordered("".join(map(FORMS.__getitem__, s)))


def normalized(s: str) -> str:
    """The table's spelling of a text, composed."""
    return unicodedata.normalize("NFC", skeleton(s))


@lru_cache(maxsize=1)
def _units() -> re.Pattern[str]:
    """A character with the accents, those of half width too, and unseen
    characters behind it."""
    behind = [c for c in [*range(0x300, 0x20000), *range(0xE0000, 0xE01F0), 0xAD] if unicodedata.combining(chr(c)) or FORMS[chr(c)] == "" or unicodedata.combining(FORMS[chr(c)][0])]
    runs: list[list[int]] = []
    for c in sorted(behind):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile(".[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]*", re.S)


class _Labels(dict):
    """unit -> the edges it walks at no cost: none if it can't be seen, several
    for a ligature."""

    def __missing__(self, unit: str) -> tuple[str, ...]:
        labels: list[str] = []
        for c in skeleton(unit):
            if labels and unicodedata.combining(c):
                labels[-1] += c
            else:
                labels.append(c)
        if len(self) > 200_000:
            self.clear()
        out = self[unit] = tuple(labels)
        return out


LABELS = _Labels()


def _trimmed(text: str) -> list[str]:
    """The text's units without the blanks and unseen characters at its ends."""
    units = _units().findall(text)
    while units and LABELS[units[-1]] in ((" ",), ()):
        units.pop()
    first = next((i for i, u in enumerate(units) if LABELS[u] not in ((" ",), ())), 0)
    return units[first:]


def _look(text: str) -> str:
    """The edges that the whole text walks, in one string: texts that arrive at
    the same names have the same."""
    return "".join(label for u in _trimmed(text) for label in LABELS[u])


def _is_odd(name: str, look: str) -> bool:
    """Whether printable ASCII text may look like the name and differ from it."""
    return look != name and look.isascii()


def _is_plain(text: str) -> bool:
    """Whether the text is its own look: printable ASCII."""
    return text.isascii() and text.isprintable()


class _Words:
    """A text by units, and where whole words begin and end in it."""

    def __init__(self, text: str) -> None:
        self.text, self.units = text, _units().findall(text)
        self.looks = [LABELS[u] for u in self.units]
        self.offsets = [0, *accumulate(map(len, self.units))]

    def starts(self) -> Iterator[int]:
        before = False  # a word's character stands before, unseen ones aside
        for at, labels in enumerate(self.looks):
            if labels:
                if not before:
                    yield at
                before = _in_word(labels[-1][0])

    def stops(self, end: int) -> bool:
        """Whether no word goes on at ``end``."""
        return end == len(self.units) or not _in_word(self.looks[end][0][0])

    def span(self, at: int, end: int) -> tuple[int, int]:
        """The place in the text, with the unseen characters before."""
        first = self.offsets[at]
        while first and not FORMS[self.text[first - 1]]:
            first -= 1
        return first, self.offsets[end]


class Trie:
    """Vocabulary trie with the automaton's walk."""

    def __init__(self, names: Iterable[tuple[int, str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, str]]] = [[]]
        self.odd = False  # a name is written otherwise than in printable ASCII that it looks like
        for ident, name in names:
            node = 0
            units = _trimmed(name)
            self.odd |= _is_odd(name, _look(name))
            for unit in units:
                for label in LABELS[unit]:
                    child = self.next[node].get(label)
                    if child is None:
                        child = self.next[node][label] = len(self.next)
                        self.next.append({})
                        self.ends.append([])
                    node = child
            if node:
                self.ends[node].append((ident, name))

    def walk(self, units: list[str], start: int = 0, budget: int = 0) -> Iterator[tuple[int, int, int]]:
        """``(end, node, cost)`` of every way from unit ``start`` to a name's node."""
        next_, ends = self.next, self.ends
        states = {0: 0}
        for at in range(start, len(units) + 1):
            if budget:
                states = self._inserted(states, budget)
            for node, cost in states.items():
                if ends[node]:
                    yield at, node, cost
            if at == len(units):
                return
            labels, moved = LABELS[units[at]], {}
            for node, cost in states.items():
                child: int | None = node
                for label in labels:  # the free edges: none, one or several
                    child = next_[child].get(label)
                    if child is None:
                        break
                if child is not None and moved.get(child, budget + 1) > cost:
                    moved[child] = cost
                if cost < budget and labels:
                    if moved.get(node, budget + 1) > cost + 1:
                        moved[node] = cost + 1
                    for other in next_[node].values():
                        if moved.get(other, budget + 1) > cost + 1:
                            moved[other] = cost + 1
            if not moved:
                return
            states = moved

    def _inserted(self, states: dict[int, int], budget: int) -> dict[int, int]:
        """States reached by characters of the name that the text lacks."""
        out, todo = dict(states), list(states.items())
        while todo:
            node, cost = todo.pop()
            if cost < budget:
                for child in self.next[node].values():
                    if out.get(child, budget + 1) > cost + 1:
                        out[child] = cost + 1
                        todo.append((child, cost + 1))
        return out

    def whole(self, text: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """``(id, name, cost)`` of the names the whole text arrives at; blanks
        at its ends don't count."""
        units = _trimmed(text)
        best: dict[tuple[int, str], tuple[int, str, int]] = {}
        for end, node, cost in self.walk(units, 0, budget):
            if end == len(units):
                for ident, name in self.ends[node]:
                    if (ident, name) not in best or best[ident, name][2] > cost:
                        best[ident, name] = (ident, name, cost)
        return list(best.values())

    def within(self, text: str, budget: int = 0) -> list[tuple[int, int, int, str]]:
        """``(start, end, id, name)`` of names within a text as whole words;
        with a budget those of the least cost at each place."""
        places = _Words(text)
        units, looks = places.units, places.looks
        root = self.next[0]
        out: list[tuple[int, int, int, str]] = []
        for at in places.starts():
            if looks[at][0] in root or budget and _in_word(looks[at][-1][0]):
                least: dict[tuple[int, int], int] = {}
                for end, node, cost in self.walk(units, at, budget):
                    if end == at or not places.stops(end):
                        continue
                    if least.get((end, node), budget + 1) > cost:
                        least[end, node] = cost
                top = min(least.values(), default=0)
                for (end, node), cost in least.items():
                    if cost == top:
                        first, last = places.span(at, end)
                        out += [(first, last, ident, name) for ident, name in self.ends[node]]
        return out


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "-'’_" or bool(unicodedata.combining(c))


@lru_cache(maxsize=2)
def _trie(names: tuple[tuple[int, str], ...]) -> Trie:
    return Trie(names)


def _text(column: pa.Array) -> list[str | None]:
    if pa.types.is_list(column.type):
        return [None if t is None else " ".join(x for x in t if x is not None) for t in column.to_pylist()]
    return column.to_pylist()


def find_lookalikes(df: DataFrame, ident: str, fields: list[str], names: DataFrame, name_id: str = "name_id", name: str = "name", broadcast_bytes: int = BROADCAST_BYTES, budget: int = 0) -> DataFrame:
    """Distinct ``(row_id, field_name, name_id)``.  String fields are judged as
    a whole, lists of tokens by whole words within the tokens joined by single
    spaces.  The vocabulary is broadcast if it is counted below
    ``broadcast_bytes``; beyond, looks are joined, with equal rows.  A join
    allows no edits, so a ``budget`` is refused there."""
    names = names.select(name_id, name).where(F.col(name).isNotNull())
    schema = T.StructType([T.StructField("row_id", df.schema[ident].dataType), T.StructField("field_name", T.StringType()), T.StructField(name_id, names.schema[name_id].dataType)])
    if not fits_broadcast(names, broadcast_bytes):
        if budget:
            raise ValueError("edits need a vocabulary that fits a broadcast")
        return _joined(df, ident, fields, names.toDF("name_id", "name")).toDF("row_id", "field_name", name_id).distinct()
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted((tuple(r) for r in names.collect()), key=str)))
    kind = to_arrow_type(schema[name_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows, labels, ids = [], [], []
            for f, field in enumerate(fields):
                column = batch.column(1 + f)
                words = pa.types.is_list(column.type)
                for i, text in enumerate(_text(column)):
                    if not text or not budget and not trie.odd and _is_plain(text) and (words or text == text.strip()):
                        continue
                    got = known.get(text) if not words else None
                    if got is None:
                        if words:
                            got = sorted({k for a, b, k, n in trie.within(text, budget) if text[a:b] != n}, key=str)
                        else:
                            got = sorted({k for k, n, _ in trie.whole(text, budget) if text != n}, key=str)
                            known[text] = got
                            if len(known) > 200_000:
                                known.clear()
                    for k in got:
                        rows.append(i)
                        labels.append(field)
                        ids.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(labels, pa.string()), pa.array(ids, kind)], [x.name for x in schema])

    return df.select(ident, *fields).mapInArrow(run, schema).distinct()


def _looks_of(names: DataFrame) -> tuple[DataFrame, int, bool]:
    """The names with their looks, the length of the longest, and whether a
    name is odd."""
    look = F.pandas_udf(lambda s: s.map(_look), "string")
    vocabulary = names.withColumn("look", look("name")).where("look <> ''")
    odd = (F.col("look") != F.col("name")) & F.col("look").rlike(r"^[\x00-\x7F]*$")
    longest, some = vocabulary.agg(F.max(F.length("look")), F.max(odd)).first()
    return vocabulary, longest or 0, bool(some)


def _joined(df: DataFrame, ident: str, fields: list[str], names: DataFrame) -> DataFrame:
    """For vocabularies without a proven size: (look, surface) rows of fields
    and of the places of a text where a name can stand, joined on the look."""
    vocabulary, longest, odd = _looks_of(names)
    schema = T.StructType([T.StructField("row_id", df.schema[ident].dataType), *[T.StructField(c, T.StringType()) for c in ("field_name", "look", "surface")]])

    def surfaces(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, str]]:
        for f, field in enumerate(fields):
            column = batch.column(1 + f)
            words = pa.types.is_list(column.type)
            for i, text in enumerate(_text(column)):
                if not text or not odd and _is_plain(text) and (words or text == text.strip()):
                    continue
                if words:
                    for a, b, look in _places(text, longest):
                        yield i, field, look, text[a:b]
                elif 0 < len(look := _look(text)) <= longest:
                    yield i, field, look, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = surfaces(batch)
            while part := list(islice(found, 10_000)):
                rows, *rest = zip(*part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.string()) for x in rest]], schema.names)

    return df.select(ident, *fields).mapInArrow(run, schema).join(vocabulary, "look").where("surface <> name").select("row_id", "field_name", "name_id")


def canonical(df: DataFrame, ident: str, field: str, names: DataFrame, out: str = "canonical", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(ident, out)`` of every row: names in their canonical spelling, the
    rest by the table; null stays null.  The vocabulary is broadcast if it is
    counted below ``broadcast_bytes``; beyond, looks are joined."""
    names = names.select("name_id", "name").where(F.col("name").isNotNull())
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(out, T.StringType())])
    if not fits_broadcast(names, broadcast_bytes):
        return _canonical_joined(df, ident, field, names, out)
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted((tuple(r) for r in names.collect()), key=str)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)

        def rewrite(text: str | None) -> str | None:
            return text if text is None or not trie.odd and _is_plain(text) else _rewritten(text, trie.within(text))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rewrite(t) for t in _text(batch.column(1))], pa.string())], schema.names)

    return df.select(ident, field).mapInArrow(run, schema)


def _rewritten(text: str, found: list[tuple[int, int, int, str]]) -> str:
    """Names found in their canonical spelling; of several that begin at one
    place the longest, of those that look the same the first by id."""
    parts, at = [], 0
    for a, b, _, name in sorted(found, key=lambda x: (x[0], -x[1], str(x[2]))):
        if a >= at:
            parts += [normalized(text[at:a]), name]
            at = b
    return "".join([*parts, normalized(text[at:])])


def _canonical_joined(df: DataFrame, ident: str, field: str, names: DataFrame, out: str) -> DataFrame:
    """For vocabularies without a proven size: the places of a text where a
    name can stand, joined on the look, and gathered again by text."""
    vocabulary, longest, any_odd = _looks_of(names)
    text = F.concat_ws(" ", field) if isinstance(df.schema[field].dataType, T.ArrayType) else F.col(field)
    rows = df.select(F.col(ident).alias("i"), F.when(F.col(field).isNotNull(), text).alias("t"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                got = list(_places(t, longest))
                for k in range(0, len(got), 10_000):
                    part = got[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(part), pa.string()), *[pa.array([p[j] for p in part], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]], ["t", "a", "b", "look"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [t if t is None or not any_odd and _is_plain(t) else _rewritten(t, [(x["a"], x["b"], x["name_id"], x["name"]) for x in f or []]) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], [ident, out])

    unlike = rows.where(F.col("t").isNotNull() & (F.lit(any_odd) | F.col("t").rlike("[^ -~]"))).select("t").distinct()
    hits = unlike.mapInArrow(places, "t string, a int, b int, look string").join(vocabulary, "look").groupBy("t").agg(F.collect_list(F.struct("a", "b", "name_id", "name")).alias("found"))
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(out, T.StringType())])
    return rows.join(hits, "t", "left").select("i", "t", "found").mapInArrow(rewrite, schema)


def _places(text: str, longest: int) -> Iterator[tuple[int, int, str]]:
    """``(start, end, look)`` of whole words and runs of them whose look is no
    longer than ``longest``, the longest of a name, with the borders of
    :meth:`Trie.within`."""
    places = _Words(text)
    for at in places.starts():
        look = ""
        for end in range(at + 1, len(places.units) + 1):
            look += "".join(places.looks[end - 1])
            if len(look) > longest:
                break
            if places.stops(end):
                yield *places.span(at, end), look
