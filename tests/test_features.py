import re

from tagweave.functions import features as ft

TOKENS = ["12abc", "-3.5", ".5", "²", "don't", "_", "A", "©2014", "100,000", "Maandag", "mrt.", "a@b.co", "x@y.museum", "t/m", "--", "Hello", "HELLO", "hello", "heLLo", "12:30", "1999", "2099", "1899", "a.", ".", "b:", ":", "Ave.", "N", "né", "3a5", "ab1", "'", "Élan", "X1X"]


def shape(t):
    for pattern, name in ((r"[-+]?[0-9]+(\.[0-9]*)?|[0-9]*\.[0-9]+$", "number"), (r"\W+$", "punct"), (r"[A-Z][a-z'`]+$", "upcase"), (r"[A-Z][A-Z'`]+$", "caps"), (r"[a-z]+$", "downcase"), (r"\w+$", "mixedcase")):
        if re.match(pattern, t):
            return name
    return "other"


def test_scalar_features_against_plain_rules(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    builders = [ft.token_identity, ft.token_lower, ft.token_shape, ft.token_endswith_dot, ft.token_endswith_colon, ft.token_has_copyright, ft.number_pattern, ft.prefixes_and_suffixes, ft.looks_like_year, ft.looks_like_month, ft.looks_like_weekday, ft.looks_like_time, ft.looks_like_email, ft.looks_like_street_part, ft.looks_like_range, ft.bias]
    for r in df.select(*ft.apply(builders, "token")).collect():
        t, low = r.token, r.token.lower()
        assert r.shape == shape(t), t
        assert (r.lower, r.prefix3, r.suffix3, r.bias) == (low, low[:3], low[-3:], 1)
        assert r.endswith_dot == (t.endswith(".") and t != ".") and r.endswith_colon == (t.endswith(":") and t != ":")
        assert r.has_copyright == ("©" in t) and r.first_upper == (t[0].isupper())
        digits = sum(c.isdecimal() for c in t)
        if digits / len(t) >= 0.3:
            x = re.sub(r"\d", "X", t)
            assert (r.num_pattern, r.num_pattern2) == (x, re.sub(r"[^X\W]", "C", x)), t
        else:
            assert r.num_pattern is None and r.num_pattern2 is None
        assert r.looks_like_year == bool(re.fullmatch(r"(19|20)\d\d", t))
        assert r.looks_like_time == bool(re.match(r"\d{1,2}[.:]\d{2}", t))
        assert r.looks_like_email == (t in ("a@b.co", "x@y.museum"))
        assert r.looks_like_month == (low == "mrt.") and r.looks_like_weekday == (low == "maandag")
        assert (r.common_street_part, r.direction, r.looks_like_range) == (low == "ave.", low == "n", low == "t/m")


def test_custom_affixes_and_blocks(spark):
    df = spark.createDataFrame([("Abcdef", 0, 1, ["html", "body", "a"], "a"), ("x", 20, 21, ["html"], "html")], "token string, index int, block_len int, ancestors array<string>, parent string")
    from pyspark.sql import functions as F

    named = {**ft.borders(F.col("index"), F.col("block_len")), **ft.block_length(F.col("block_len")), **ft.inside_tag("a", F.col("ancestors")), **ft.parent_tag(F.col("parent"))}
    a, b = df.select(*[c.alias(n) for n, c in named.items()], *ft.apply([ft.prefixes((5,), "p", lower=False), ft.suffixes((2,), "s")], "token")).collect()
    assert (a.border_at_left, a.border_at_right, a.block_length, a.inside_tag_a, a.parent_tag, a.p5, a.s2) == (True, True, "1", True, "a", "Abcde", "ef")
    assert (b.border_at_left, b.border_at_right, b.block_length, b.inside_tag_a) == (False, True, "large", False)
