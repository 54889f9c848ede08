"""Token features as expressions over a token column.

A builder maps names of columns to a dict of feature name -> Column, so that
only the features a query uses are computed.  ``None`` in a row means that the
feature is absent.  Letters, digits and word characters are the Unicode ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[[Column], dict[str, Column]]

# Word lists of the feature definitions.
MONTHS = (
    "jan january januari jan. feb february februari feb. mar mrt maart march mrt. maa. maa apr april apr. may mei jun june juni jun. jul july juli jul."
    " aug august augustus aug. sep september sep. okt oct october oktober okt. nov november nov. dec december dec."
).split()
WEEKDAYS = (
    "mon monday maandag ma. ma tue tuesday dinsdag di. di wed wednesday woensdag wo. wo thu thursday donderdag do. do"
    " fri friday vrijdag vr. vr sat saturday zaterdag za. za sun sunday zondag zo. zo"
).split()
STREET_PARTS = (
    "avenue ave ave. boulevard blvd blvd. street str. st. road rd rd. drive dr dr. lane ln ln. court circle place pl ridgeway parkway highway park unit block"
).split()
ADDRESS_PARTS = "suite floor p.o. po center".split()
DIRECTIONS = "north south east west n s e w n. s. e. w. ne se sw nw northeast southeast southwest northwest".split()
RANGES = "t/m - van tot from to".split()
ZONES = "[a-z]{2}|aero|asia|biz|cat|com|coop|edu|gov|info|int|jobs|mil|moby|museum|name|net|org|pro|tel|travel|xxx"

WORD = r"[\p{L}\p{N}_]"
#: A number as the shape rule reads it; its first branch has no end, so a digit at the start is enough.
NUMBER = r"\A(?:[+\-]?[0-9]|\.[0-9]+\z)"
EMAIL = rf"(?i)(?:[\s\x1c-\x1f\x85\p{{Z}}]|%20|(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD})){WORD}[\p{{L}}\p{{N}}_.\-]*@{WORD}[\p{{L}}\p{{N}}_.\-]*\.(?:{ZONES})(?:(?<={WORD})(?!{WORD}))"


def bias(t: Column) -> dict[str, Column]:
    return {"bias": F.lit(1)}


def token_identity(t: Column) -> dict[str, Column]:
    return {"token": t}


def token_lower(t: Column) -> dict[str, Column]:
    return {"lower": F.lower(t)}


def shape(t: Column) -> Column:
    """Word shape by the first test that holds."""
    return (
        F.when(t.rlike(NUMBER), "number")
        .when(t.rlike(r"\A[^\p{L}\p{N}_]+\z"), "punct")
        .when(t.rlike(r"\A[A-Z][a-z'`]+\z"), "upcase")
        .when(t.rlike(r"\A[A-Z][A-Z'`]+\z"), "caps")
        .when(t.rlike(r"\A[a-z]+\z"), "downcase")
        .when(t.rlike(rf"\A{WORD}+\z"), "mixedcase")
        .otherwise("other")
    )


def token_shape(t: Column) -> dict[str, Column]:
    return {"shape": shape(t), "first_upper": t.rlike(r"\A\p{Lu}")}


def token_endswith_dot(t: Column) -> dict[str, Column]:
    return {"endswith_dot": t.endswith(".") & (t != ".")}


def token_endswith_colon(t: Column) -> dict[str, Column]:
    return {"endswith_colon": t.endswith(":") & (t != ":")}


def token_has_copyright(t: Column) -> dict[str, Column]:
    return {"has_copyright": t.contains("©")}


def number_pattern(t: Column) -> dict[str, Column]:
    """Digits as ``X``; then other word characters as ``C``.  Absent where
    fewer than three in ten characters are digits."""
    enough = F.length(F.regexp_replace(t, r"[^\p{Nd}]", "")) >= F.length(t) * 0.3
    x = F.regexp_replace(t, r"\p{Nd}", "X")
    return {"num_pattern": F.when(enough & (F.length(t) > 0), x), "num_pattern2": F.when(enough & (F.length(t) > 0), F.regexp_replace(x, r"[\p{L}\p{N}_&&[^X]]", "C"))}


def prefixes(lengths: tuple[int, ...] = (2, 3, 4), name: str = "prefix", lower: bool = True) -> Builder:
    def build(t: Column) -> dict[str, Column]:
        s = F.lower(t) if lower else t
        return {f"{name}{k}": F.substring(s, 1, k) for k in lengths}

    return build


def suffixes(lengths: tuple[int, ...] = (2, 3, 4), name: str = "suffix", lower: bool = True) -> Builder:
    def build(t: Column) -> dict[str, Column]:
        s = F.lower(t) if lower else t
        return {f"{name}{k}": F.right(s, F.lit(k)) for k in lengths}

    return build


def prefixes_and_suffixes(t: Column) -> dict[str, Column]:
    return {**prefixes()(t), **suffixes()(t)}


def looks_like_year(t: Column) -> dict[str, Column]:
    return {"looks_like_year": t.rlike(r"\A(?:19|20)\p{Nd}{2}\z")}


def looks_like_month(t: Column) -> dict[str, Column]:
    return {"looks_like_month": F.lower(t).isin(*MONTHS)}


def looks_like_weekday(t: Column) -> dict[str, Column]:
    return {"looks_like_weekday": F.lower(t).isin(*WEEKDAYS)}


def looks_like_time(t: Column) -> dict[str, Column]:
    return {"looks_like_time": t.rlike(r"\A\p{Nd}{1,2}[.:]\p{Nd}{2}")}


def looks_like_email(t: Column) -> dict[str, Column]:
    return {"looks_like_email": t.rlike(EMAIL)}


def looks_like_street_part(t: Column) -> dict[str, Column]:
    low = F.lower(t)
    return {"common_street_part": low.isin(*STREET_PARTS), "common_address_part": low.isin(*ADDRESS_PARTS), "direction": low.isin(*DIRECTIONS)}


def looks_like_range(t: Column) -> dict[str, Column]:
    return {"looks_like_range": F.lower(t).isin(*RANGES)}


# --- block features: over columns of the token table -----------------------------


def parent_tag(parent: Column) -> dict[str, Column]:
    return {"parent_tag": parent}


def inside_tag(tag: str, ancestors: Column) -> dict[str, Column]:
    """Whether the element itself or one above it has the tag."""
    return {f"inside_tag_{tag}": F.array_contains(ancestors, tag)}


def borders(index: Column, block_len: Column) -> dict[str, Column]:
    return {"border_at_left": index == 0, "border_at_right": index == block_len - 1}


def block_length(block_len: Column) -> dict[str, Column]:
    return {"block_length": F.when(block_len == 1, "1").when(block_len <= 10, "short").when(block_len <= 20, "medium").otherwise("large")}


# The token features of the example bundle; the contact bundle has
# the same.  Features of the block (parent tag, inside a and strong, borders,
# length) come with the token table, see the pipeline.
EXAMPLE_FEATURES: list[Builder] = [bias, token_identity, token_lower, token_shape, token_endswith_colon, token_endswith_dot, token_has_copyright, number_pattern, prefixes_and_suffixes, looks_like_year, looks_like_month, looks_like_email, looks_like_street_part]
CONTACT_FEATURES: list[Builder] = [*EXAMPLE_FEATURES]
# Entity types of the example, of contacts and of addresses.
ENTITY_TYPES = "ORG TEL FAX HOURS STREET CITY STATE ZIPCODE COUNTRY EMAIL PER FUNC SUBJ".split()
CONTACT_TYPES = "ORG TEL FAX HOURS STREET CITY STATE ZIPCODE COUNTRY SUBJ".split()
ADDRESS_TYPES = "STREET CITY STATE ZIPCODE COUNTRY".split()


def apply(builders: list[Builder], token: Column | str) -> list[Column]:
    """Aliased feature columns of several builders; of equal names the last."""
    t = F.col(token) if isinstance(token, str) else token
    merged: dict[str, Column] = {}
    for b in builders:
        merged.update(b(t))
    return [c.alias(n) for n, c in merged.items()]
