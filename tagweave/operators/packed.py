"""Several values packed in one field -> one row per value, with its place.

Each Arrow batch is handled as one byte buffer.  Quote parity, escapes and
separators are byte masks over the whole buffer; a ``keep`` mask drops
separators, outer blanks, quotes and escape signs in one gather, and the child
offsets are differences of its running sum.  No value is looked at one by one
except JSON arrays (decoded by ``json``) and rows whose double quotes are not
regular (an opening quote inside a value), which go to :func:`split_scalar`,
the plain statement of the same rules.

Rules.  Separators: ``, ; | 、 ， ；`` line breaks, tabs, and a slash between
blanks, mixed at will.  A separator inside quotes or after a backslash belongs
to the value.  ``"`` opens a quote at the start of a slot and is doubled or
escaped inside; ``'`` does so only if a closing ``'`` ends a slot before
another one opens (so ``'t Traziolk`` is a value).  Brackets or braces around
the whole field are dropped.  Empty slots are no values and take no place.

Defined results: null and empty fields give no row; repeated values and rows
come out again; columns that clash with the output names are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEPARATORS = ",;|\n\r\t、，；"
_SINGLE = np.zeros(256, bool)
_SINGLE[[ord(c) for c in ",;|\n\r\t"]] = True
_WIDE = [c.encode() for c in "、，；"]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 13]] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[[ord(c) for c in ",;|/\"'\\ "] + [w[0] for w in _WIDE]] = True
_BLANKS = " \t\n\r"


def _sep_at(s: str, i: int) -> bool:
    c = s[i]
    return c in SEPARATORS or (c == "/" and 0 < i < len(s) - 1 and s[i - 1] == " " and s[i + 1] == " ")


def split_scalar(s: str | None) -> list[str]:
    """The rules of this module for one field, read from left to right."""
    if s is None:
        return []
    bare = s.strip(_BLANKS)
    if bare[:1] == "[" and bare[-1:] == "]":
        try:
            got = json.loads(bare)
            if isinstance(got, list) and all(isinstance(x, str) for x in got):
                return [y for x in got if (y := x.strip(_BLANKS))]
        except ValueError:
            pass
    if len(bare) > 1 and bare[0] + bare[-1] in ("[]", "{}"):
        s = bare[1:-1]
    out, i, n = [], 0, len(s)
    while i <= n:
        while i < n and s[i] in _BLANKS and s[i] not in SEPARATORS:
            i += 1
        end = _quoted_end(s, i) if i < n and s[i] in "\"'" else None
        if end is not None:
            mark, body = s[i], s[i + 1 : end]
            value = _unescape(body.replace(mark * 2, mark) if mark == '"' else body)
            i = end + 1
            while i < n and not _sep_at(s, i):
                i += 1
        else:
            start = i
            while i < n and not _sep_at(s, i):
                i += 2 if s[i] == "\\" and i + 1 < n and s[i + 1] in ",;|/\"'\\ 、，；" else 1
            i = min(i, n)
            value = _unescape(s[start:i])
        if value := value.strip(_BLANKS):
            out.append(value)
        i += 1
    return out


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out, i = [], 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in ",;|/\"'\\ 、，；":
            i += 1
        out.append(s[i])
        i += 1
    return "".join(out)


def _ends_slot(s: str, i: int) -> bool:
    while i < len(s) and s[i] in " ":
        i += 1
    return i >= len(s) or _sep_at(s, i) or (s[i] == "/" and _sep_at(s, i))


def _quoted_end(s: str, i: int) -> int | None:
    mark, j = s[i], i + 1
    while j < len(s):
        if s[j] == "\\":
            j += 2
            continue
        if s[j] == mark:
            if mark == '"' and s[j + 1 : j + 2] == mark:
                j += 2
                continue
            if _ends_slot(s, j + 1):
                return j if j > i + 1 or mark == '"' else None
            if mark == '"':
                return None
            k = j - 1
            while k > i and s[k] == " ":
                k -= 1
            if _sep_at(s, k):
                return None
        j += 1
    return None


def split_batch(col: pa.Array) -> pa.ListArray:
    """List array of the values of every field of ``col`` (null -> empty)."""
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.string()))
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :]
    base = off[0]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[base : off[-1]] if data is not None and off[-1] > base else np.zeros(0, np.uint8)
    start, end = off[:-1] - base, off[1:] - base
    if col.null_count:
        end = np.where(np.asarray(col.is_valid()), end, start)
    size = len(buf)
    blank = _BLANK[buf]
    solid = np.flatnonzero(~blank)

    def tighten(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans without their outer blanks; whether anything is left."""
        if not len(solid):
            return a, a, np.zeros(len(a), bool)
        lo = np.searchsorted(solid, a)
        hi = np.searchsorted(solid, b) - 1
        some = hi >= lo
        return np.where(some, solid[np.minimum(lo, len(solid) - 1)], a), np.where(some, solid[np.maximum(hi, 0)] + 1, a), some

    rs, re_, some = tighten(start, end)
    first = np.where(some, buf[np.minimum(rs, size - 1)], 0) if size else np.zeros(n)
    last = np.where(some, buf[np.maximum(re_ - 1, 0)], 0) if size else np.zeros(n)
    wide = re_ - rs > 1
    is_json = wide & (first == 91) & (last == 93)
    wrapped = is_json | (wide & (first == 123) & (last == 125))
    rs, re_ = rs + wrapped, re_ - wrapped
    if not size:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))

    row = np.repeat(np.arange(n), end - start)
    inside = np.zeros(size + 1, np.int32)
    np.add.at(inside, rs, 1)
    np.add.at(inside, re_, -1)
    inside = np.cumsum(inside)[:-1] > 0

    # escapes: a backslash at an even place of its run, before something escapable
    back = (buf == 92) & inside
    escape = np.zeros(size, bool)
    if back.any():
        at = np.flatnonzero(back)
        new = np.r_[True, np.diff(at) != 1]
        run = at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        lead = at[run % 2 == 0]
        lead = lead[lead + 1 < size]
        escape[lead[_ESCAPABLE[buf[lead + 1]] & inside[lead + 1] & (row[lead + 1] == row[lead])]] = True
    escaped = np.r_[False, escape[:-1]]

    sep = _SINGLE[buf]
    for w in _WIDE:
        hit = np.flatnonzero((buf[:-2] == w[0]) & (buf[1:-1] == w[1]) & (buf[2:] == w[2])) if size > 2 else np.zeros(0, int)
        hit = hit[~escaped[hit]]
        sep[hit] = True
    slash = np.flatnonzero(buf[1:-1] == 47) + 1 if size > 2 else np.zeros(0, int)
    sep[slash[(buf[slash - 1] == 32) & (buf[slash + 1] == 32)]] = True
    sep &= inside & ~escaped

    def whole(border: np.ndarray) -> np.ndarray:
        """``border`` with all three bytes of the wide separators."""
        w = np.flatnonzero(border & (buf >= 0x80))
        border = border.copy()
        border[w + 1] = border[w + 2] = True
        return border

    # double quotes by parity within the row
    dq = np.flatnonzero((buf == 34) & inside & ~escaped)
    quoted = np.zeros(size, bool)
    double = np.zeros(size, bool)
    irregular = np.zeros(n, bool)
    if len(dq):
        odd = np.bincount(row[dq], minlength=n) % 2 == 1
        irregular |= odd
        dq = dq[~odd[row[dq]]]
    if len(dq):
        drow = row[dq]
        head = np.r_[True, drow[1:] != drow[:-1]]
        opening = np.arange(len(dq)) % 2 == 0  # every row has an even number
        mark = np.zeros(size + 1, np.int32)
        mark[dq[opening]] = 1
        mark[dq[~opening] + 1] -= 1
        quoted = np.cumsum(mark)[:-1] > 0
        doubled = opening & ~head & (np.r_[-9, dq[:-1]] == dq - 1)
        double[dq[doubled]] = True
        outer = whole(sep & ~quoted)
        bad_open = opening & ~doubled & ~_before(dq, outer, blank, rs[drow])
        bad_close = ~opening & ~np.r_[doubled[1:], False] & ~_after(dq, outer, blank, re_[drow])
        irregular[drow[bad_open | bad_close]] = True
        sep &= ~quoted

    # single quotes: an opening one directly followed, among slot borders, by a closing one
    sq = np.flatnonzero((buf == 39) & inside & ~escaped & ~quoted)
    outer1 = np.zeros(size, bool)
    if len(sq):
        srow = row[sq]
        border = whole(sep)
        opens = _before(sq, border, blank, rs[srow])
        closes = _after(sq, border, blank, re_[srow])
        keep_ = opens ^ closes
        sq, srow, opens = sq[keep_], srow[keep_], opens[keep_]
        pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (srow[:-1] == srow[1:])) if len(sq) > 1 else np.zeros(0, int)
        if len(pair):
            a, b = sq[pair], sq[pair + 1]
            mark = np.zeros(size + 1, np.int32)
            np.add.at(mark, a, 1)
            np.add.at(mark, b + 1, -1)
            sep &= np.cumsum(mark)[:-1] == 0
            outer1[a] = outer1[b] = True

    special = irregular | is_json
    # children
    cut = np.flatnonzero(sep)
    crow = row[cut]
    a = np.concatenate([rs, cut + 1 + 2 * (buf[cut] >= 0x80)])
    b = np.concatenate([re_, cut])
    owner = np.concatenate([np.arange(n), crow])
    order = np.lexsort((a, owner))
    a, owner = a[order], owner[order]
    order = np.lexsort((b, np.concatenate([np.arange(n), crow])))
    b = b[order]
    a, b, ok = tighten(a, np.maximum(a, b))
    ok &= ~special[owner]
    a, b, owner = a[ok], b[ok], owner[ok]
    q = (b - a > 1) & (((buf[a] == 34) & (buf[b - 1] == 34) & ~escaped[b - 1]) | (outer1[a] & outer1[b - 1])) if len(a) else np.zeros(0, bool)
    a, b = a + q, b - q
    a, b, ok = tighten(a, b)
    a, b, owner = a[ok], b[ok], owner[ok]
    span = np.zeros(size + 1, np.int32)
    np.add.at(span, a, 1)
    np.add.at(span, b, -1)
    keep = (np.cumsum(span)[:-1] > 0) & ~escape & ~double
    total = np.r_[0, np.cumsum(keep)]
    length = total[b] - total[a]
    body = buf[keep]
    values_off = np.r_[0, np.cumsum(length)].astype(np.int32)
    values = pa.StringArray.from_buffers(len(length), pa.py_buffer(values_off), pa.py_buffer(np.ascontiguousarray(body)))
    if (length == 0).any():
        some_ = length > 0
        values, owner = values.filter(pa.array(some_)), owner[some_]
    counts = np.bincount(owner, minlength=n)
    if special.any():  # splice in the rows read one by one
        extra = {int(r): split_scalar(col[int(r)].as_py()) for r in np.flatnonzero(special)}
        erow = np.repeat(list(extra), [len(v) for v in extra.values()]).astype(int)
        values = pa.concat_arrays([values, pa.array([x for v in extra.values() for x in v], pa.string())])
        both = np.concatenate([owner, erow])
        values = values.take(pa.array(np.argsort(both, kind="stable")))
        counts = np.bincount(both, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def _before(at: np.ndarray, border: np.ndarray, blank: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Whether, blanks aside, a border or the row's start comes before ``at``."""
    stop = np.flatnonzero(border | ~blank)
    k = np.searchsorted(stop, at) - 1
    p = np.where(k >= 0, stop[np.maximum(k, 0)], -1) if len(stop) else np.full(len(at), -1)
    return (p < row_start) | border[np.maximum(p, 0)]


def _after(at: np.ndarray, border: np.ndarray, blank: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """Whether, blanks aside, a border or the row's end comes after ``at``."""
    stop = np.flatnonzero(border | ~blank)
    k = np.searchsorted(stop, at, side="right")
    p = np.where(k < len(stop), stop[np.minimum(k, len(stop) - 1)], len(border)) if len(stop) else np.full(len(at), len(border))
    return (p >= row_end) | border[np.minimum(p, len(border) - 1)]


def explode_packed(df: DataFrame, field: str, ident: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """``(ident, pos, value)``: one row for every value packed in ``field``.

    No shuffle: a scan of two columns, one Arrow pass, rows out.
    """
    kind = df.schema[ident].dataType
    schema = T.StructType([T.StructField(ident, kind), T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_batch(batch.column(1))
            parents = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else _parents(lists)
            starts = np.asarray(lists.offsets)[:-1]
            owner = np.asarray(parents)
            nth = np.arange(len(owner)) - starts[owner] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(parents), pa.array(nth.astype(np.int32)), lists.values], [ident, pos, value])

    return df.select(ident, field).mapInArrow(run, schema)


def _parents(lists: pa.ListArray) -> pa.Array:
    off = np.asarray(lists.offsets)
    return pa.array(np.repeat(np.arange(len(lists)), np.diff(off)))
