"""Delimited lines -> typed rows, and the lines that fail with the reason.

Records are assembled quote-aware (:func:`assemble_records`): physical lines
that an open quote joins are one record.  A row of a table of lines is one
record by definition, so its physical lines are assembled among themselves and
no quote reaches into the next row; lines of files are assembled with
``max_lines`` above one.  Each record goes through Python's strict ``csv``
reader inside ``mapPartitions`` style Arrow batches; one without a quote sign
has nothing for it to judge and is only cut.  A structural exception (a quote that is
not closed, or closed and followed by something else) is caught before any
typed constructor runs; then the number of fields and the key columns are
judged, in the order ``quoting``, ``columns``, then the key columns.

Defined results: an empty line has one field, so it fails with ``columns``;
a null line fails with ``columns`` too; repeated lines are judged each for
itself; values of columns that are not judged become null if they don't fit.
Line breaks inside a line are plain characters, quoted or not.
"""

from __future__ import annotations

import csv
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagweave.schema import GEONAMES

MAX_LONG = 2**63 - 1
_DIGITS = re.compile(r"[0-9]+")
_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_ENDS = "\n\r\0"  # what csv takes for the end of a record


def whole_number(low: int) -> Callable[[str], int]:
    """Constructor of a number of plain digits from ``low`` to 2^63-1."""

    def build(s: str) -> int:
        if not _DIGITS.fullmatch(s):
            raise ValueError(s)
        digits = s.lstrip("0") or "0"
        if len(digits) > 19 or not low <= (value := int(digits)) <= MAX_LONG:
            raise ValueError(s)
        return value

    return build


def optional(build: Callable[[str], int]) -> Callable[[str], int | None]:
    return lambda s: build(s) if s else None


def parse_fields(line: str, sep: str = "\t") -> list[str]:
    """Fields of one record; ``csv.Error`` if its quoting is broken."""
    if '"' not in line:
        return line.split(sep)
    ends = [c for c in _ENDS if c in line]
    if not ends:
        return next(csv.reader((line,), delimiter=sep, strict=True), [""])
    # while csv reads it, private-use signs that the record doesn't hold stand for them
    free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in line)
    hide = {ord(c): next(free) for c in ends}
    show = {ord(v): chr(k) for k, v in hide.items()}
    return [f.translate(show) for f in next(csv.reader((line.translate(hide),), delimiter=sep, strict=True), [""])]


def _scan(line: str, sep: str, inside: bool) -> bool:
    """Whether a physical line ends within a quoted field; ``inside``: it begins
    so.  A line whose quoting breaks ends its record."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep + '"', at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        while True:  # to the quote that closes the field
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        at += 1
        if not line.startswith(sep, at):
            return False  # the end, or broken
        at, inside = at + len(sep), False


def assemble_records(lines: Iterable[str], sep: str = "\t", max_lines: int = 1) -> Iterator[str]:
    """Physical lines -> records: a line whose last quote is open takes in up
    to ``max_lines - 1`` following lines if that closes it; else it stays as it
    is and fails alone.  With ``max_lines=1`` every line is a record."""
    source, back, held, inside = iter(lines), deque(), [], False
    while (line := back.popleft() if back else next(source, None)) is not None:
        held.append(line)
        inside = max_lines > 1 and _scan(line, sep, inside)
        if not inside:
            yield "\n".join(held)
            held = []
        elif len(held) == max_lines:
            yield held[0]
            back.extendleft(reversed(held[1:]))
            held, inside = [], False
    # a quote that nothing closes: all quotes behind it are doubled, so each line stands alone
    yield from held


def _soft(kind: T.DataType) -> Callable[[str], object]:
    if isinstance(kind, T.DoubleType):
        return lambda s: float(s) if _FLOAT.fullmatch(s) else None
    if isinstance(kind, (T.IntegerType, T.LongType)):
        top = 2**31 if isinstance(kind, T.IntegerType) else 2**63
        return lambda s: v if _INT.fullmatch(s) and len(s) < 21 and -top <= (v := int(s)) < top else None
    return lambda s: s or None


def parse_lines(
    df: DataFrame,
    line: str,
    keep: list[str],
    schema: T.StructType = GEONAMES,
    judged: dict[str, Callable[[str], object]] | None = None,
    sep: str = "\t",
) -> DataFrame:
    """``keep`` columns, ``reason`` (null for valid lines), the typed columns.

    One narrow pass, no shuffle.  ``judged`` maps column -> strict constructor;
    a failure's reason is the column's name.
    """
    judged = {"geonameid": whole_number(1), "population": optional(whole_number(0))} if judged is None else judged
    names = [f.name for f in schema]
    build = [judged.get(f.name) or _soft(f.dataType) for f in schema]
    order = [(names.index(c), c) for c in judged]
    width = len(names)
    carried = [df.schema[c] for c in keep]
    out = T.StructType([*carried, T.StructField("reason", T.StringType()), *[T.StructField(f.name, f.dataType) for f in schema if f.name not in keep]])
    arrow = to_arrow_schema(out)
    typed = [i for i, n in enumerate(names) if n not in keep]

    def record(s: str) -> list[str]:
        """The row's physical lines, assembled; what no quote joins is joined
        all the same, as the row is one record."""
        if "\n" not in s or '"' not in s:
            return parse_fields(s, sep)
        physical = s.split("\n")
        return parse_fields("\n".join(assemble_records(physical, sep, len(physical))), sep)

    def judge(s: str | None) -> tuple[str | None, list[object] | None]:
        if s is None:
            return "columns", None
        try:
            fields = record(s)
        except csv.Error:
            return "quoting", None
        if len(fields) != width:
            return "columns", None
        strict = {}
        for i, name in order:
            try:
                strict[i] = build[i](fields[i])
            except ValueError:
                return name, None
        return None, [strict[i] if i in strict else build[i](fields[i]) for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            results = [judge(s) for s in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns.append(pa.array([r for r, _ in results], pa.string()))
            columns += [pa.array([v and v[i] for _, v in results], arrow.field(names[i]).type) for i in typed]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*keep, F.col(line).alias("__line")).mapInArrow(run, out)


def failures(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select(*keep, "reason")


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("reason")
