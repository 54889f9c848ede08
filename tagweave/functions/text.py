"""Text expressions: word tokens, joining, substrings, natural order.

All are Catalyst expressions without positions; :mod:`tagweave.operators.tokens`
has the variant with positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it, inside a character class of Java's regex.
W = r"\s\x1c-\x1f\x85\p{Z}"
#: One separator, quote, ellipsis, dash, comma, final dot or sign.
_RULE = (
    rf"[{W}]+|“|[\"”]|``|…|\.\.\.|--|,(?=\P{{Nd}}|\z)|\.(?=\n?\z|\n\")|[;#$£%&|!?\[\](){{}}<>]|'(?=[{W}])|''"
)
#: What can't begin a separator or sign, so needs no look-ahead.
_PLAIN = rf"[^{W}“\"”`….,\-;#$£%&|!?\[\](){{}}<>']"
#: The pieces of a text cover it completely.
PIECES = rf"(?:{_PLAIN}++|(?!{_RULE})[\s\S])++|{_RULE}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text: Column | str) -> Column:
    """Array of word tokens: quotes become ````` `` ````` or ``''``, an ellipsis ``...``;
    contractions, ``:``, ``@``, ``/`` and ``-`` don't split, a comma between
    digits and a dot before more text neither."""
    found = F.regexp_extract_all(_col(text), F.lit(PIECES), F.lit(0))

    def cut(pieces: Column) -> Column:
        def named(p: Column, i: Column) -> Column:
            before = F.try_element_at(pieces, i)  # 1-based: the piece before
            opens = (i == 0) | before.rlike(rf"[{W}(\[{{<]\z")
            return (
                F.when(p == '"', F.when(opens, F.lit("``")).otherwise(F.lit("''")))
                .when(p == "“", F.lit("``"))
                .when(p == "”", F.lit("''"))
                .when(p == "…", F.lit("..."))
                .otherwise(p)
            )

        return F.filter(F.transform(pieces, named), lambda p: ~p.rlike(rf"\A[{W}]"))

    # bound to a lambda variable, so that the text is cut once
    return F.element_at(F.transform(F.array(found), cut), 1)


def default_tokens(text: Column | str) -> Column:
    """:func:`word_tokens` without lone commas and semicolons."""
    return F.filter(word_tokens(text), lambda t: ~t.isin(",", ";"))


def smart_join(tokens: Column | str) -> Column:
    """Tokens joined by blanks, none before ``,:;.!?")`` nor after ``(``."""
    joined = F.concat_ws(" ", _col(tokens))
    return F.regexp_replace(F.regexp_replace(joined, r' ([,:;.!?")])', "$1"), r"\( ", "(")


def substrings(text: Column | str, shortest: int, longest: int, pad: str = "") -> Column:
    """All substrings by start, then length; with ``pad`` those at the text's
    start also with ``pad`` before, those at its end also with ``pad`` behind."""
    t = _col(text)
    n = F.length(t)

    def of(start: Column) -> Column:
        top = F.least(F.lit(longest), n - start + 1)
        lengths = F.when(top >= shortest, F.sequence(F.lit(shortest), top)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(lengths, lambda k: _padded(t, start, k, n, pad)))

    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, of))


def _padded(t: Column, start: Column, k: Column, n: Column, pad: str) -> Column:
    s = F.substring(t, start, k)
    if not pad:
        return F.array(s)
    p = F.lit(pad)
    none = F.array().cast("array<string>")
    return F.concat(F.when(start == 1, F.array(F.concat(p, s))).otherwise(none), F.array(s), F.when(start + k - 1 == n, F.array(F.concat(s, p))).otherwise(none))


def natural_key(text: Column | str, width: int = 20) -> Column:
    """Sort key in which runs of digits count by value: each is left-padded.
    Behind ``width`` nines come runs of that value and more: length, digits."""
    digits = F.regexp_extract_all(_col(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    nines = F.lit("9" * width)

    def pad(p: Column) -> Column:
        run = F.regexp_replace(p, r"\A0+(?=.)", "")
        long = (F.length(run) > width) | (run == nines)
        return F.when(long, F.concat(nines, F.lpad(F.length(run).cast("string"), 10, "0"), run)).otherwise(F.lpad(run, width, "0"))

    padded = F.transform(digits, lambda p: F.when(p.rlike(r"\A[0-9]"), pad(p)).otherwise(p))
    return F.array_join(padded, "")


def label_key(tag: Column | str) -> Column:
    """Sort key of IOB tags: by type, then prefix."""
    t = _col(tag)
    return F.concat(F.substring(t, 3, 1000), F.lit("-"), F.substring(t, 1, 1))


def to_str(value: Column, kind: str) -> Column:
    """A feature value as text: booleans ``1``/``0``, missing ``None``."""
    shown = F.when(value, F.lit("1")).otherwise(F.lit("0")) if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), F.lit("None")).otherwise(shown)
