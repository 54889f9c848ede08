"""Tokens of texts: golden strings, brute force, expressions against the positional variant."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagweave.functions.text import default_tokens, label_key, natural_key, smart_join, substrings, word_tokens
from tagweave.operators.tokens import block_tokens, first_blocks, segment, text_tokens, text_tokens_positions

GOLDEN = {
    "Two tickets are £7.25\nat Selm Quay.  Mail: crew@ferry.example": ["Two", "tickets", "are", "£", "7.25", "at", "Selm", "Quay.", "Mail:", "crew@ferry.example"],
    "Lantern Mews,": ["Lantern", "Mews", ","],
    "some 2,450 seats": ["some", "2,450", "seats"],
    "map|list": ["map", "|", "list"],
    '"The last boat leaves at dusk," Mira wrote.': ["``", "The", "last", "boat", "leaves", "at", "dusk", ",", "''", "Mira", "wrote", "."],
    "I'm a \"quoted\" don't": ["I'm", "a", "``", "quoted", "''", "don't"],
    "Well, so… then... and -- done.\n": ["Well", ",", "so", "...", "then", "...", "and", "--", "done", "."],
    "(A) [b] {c} <d>": ["(", "A", ")", "[", "b", "]", "{", "c", "}", "<", "d", ">"],
    "the dogs' bone ''x''": ["the", "dogs", "'", "bone", "''", "x", "''"],
    "“Ja” ``b``": ["``", "Ja", "''", "``", "b", "``"],
    'end. "Next': ["end.", "``", "Next"],
    "£5;6&7%!?": ["£", "5", ";", "6", "&", "7", "%", "!", "?"],
    "": [],
    " \xa0\n": [],
}


def brute(text):
    """Rules tried one by one at every offset, quotes first."""
    rules = [r"\s+", "“", '["”]', "``", r"…|\.\.\.", "--", r",(?=\D|$)", r"\.$", r"[;#$£%&|!?\[\](){}<>]", r"'(?=\s)|''"]
    names = {"“": "``", '"': "''", "”": "''", "…": "..."}
    out, start = [], 0
    cuts = [m.end() - 1 for m in re.finditer(r'(^|[\s(\[{<])"', text)] + [len(text)]
    for cut in cuts:
        part, i, word = text[start:cut], 0, ""
        while i < len(part):
            m = next((m for r in rules if (m := re.match(r, part[i:]))), None)
            if m:
                out += [word, "" if m.group().isspace() else names.get(m.group(), m.group())]
                word, i = "", i + m.end()
            else:
                word, i = word + part[i], i + 1
        out.append(word)
        if cut < len(text):
            out.append("``")
        start = cut + 1
    return [t for t in out if t]


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(text):
    assert [t for t, _, _ in segment(text, ())] == GOLDEN[text] == brute(text)


def strings():
    rnd = random.Random(3)
    alphabet = "ab1 9,.;:\"'`-…“”()$\n\xa0é ²"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]


def test_segments_against_brute_force():
    for s in strings():
        got = segment(s, ())
        assert [t for t, _, _ in got] == brute(s), ascii(s)
        for chars, at, n in got:
            assert chars == s[at : at + n] or chars in ("``", "''", "...")


def test_expressions_equal_segments(spark):
    texts = [*GOLDEN, *strings()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", word_tokens("text").alias("w"), default_tokens("text").alias("d")).collect():
        assert list(r.w) == brute(r.text), ascii(r.text)
        assert list(r.d) == [t for t in brute(r.text) if t not in ",;"]


def test_token_tables_and_edges(spark):
    rows = [(1, "a, b. c"), (2, None), (3, ""), (1, "a, b. c"), (4, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as pos", "'y' as token")
    a = sorted(tuple(r) for r in text_tokens(df, "doc_id", "text").where("doc_id < 4").collect())
    b = sorted(tuple(r)[:3] for r in text_tokens_positions(df, "doc_id", "text").where("doc_id < 4").collect())
    assert a == b == sorted([(1, 0, "a"), (1, 1, "b."), (1, 2, "c")] * 2)
    assert text_tokens(df, "doc_id", "text").where("doc_id = 4").count() == 60_000
    assert text_tokens_positions(df.limit(0), "doc_id", "text").count() == 0


def test_block_tokens(spark):
    rows = [(1, 10, 0, ["a", None, "b"], ["B-X", "O", "I-X"]), (2, 10, 1, None, None), (3, 10, 2, [], None), (4, 10, 3, ["c"], None), (5, 10, 0, ["dup"], None)]
    df = spark.createDataFrame(rows, "block_id long, page_id long, chunk_no int, tokens array<string>, tags array<string>")
    got = block_tokens(first_blocks(df, "page_id", "chunk_no", order="block_id")).orderBy("pos").collect()
    assert [(r.pos, r["index"], r.block_len, r.token, r.tag) for r in got] == [(0, 0, 2, "a", "B-X"), (1, 1, 2, "b", "I-X"), (2, 0, 1, "c", None)]


def test_small_expressions(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    assert f(smart_join(F.array(*map(F.lit, "Selm , Quay ( No . 3 ) : open ?".split())))) == "Selm, Quay (No. 3): open?"
    assert f(substrings(F.lit("abc"), 1, 100)) == ["a", "ab", "abc", "b", "bc", "c"]
    assert f(substrings(F.lit("abc"), 1, 2)) == ["a", "ab", "b", "bc", "c"]
    assert f(substrings(F.lit("abc"), 1, 3, "$")) == ["$a", "a", "$ab", "ab", "$abc", "abc", "abc$", "b", "bc", "bc$", "c", "c$"]
    assert f(substrings(F.lit(""), 1, 3)) == [] and f(substrings(F.lit("a"), 2, 3)) == []
    names = spark.createDataFrame([("x10",), ("x9",), ("x1b",), ("a2",), ("x009",)], "n string")
    assert [r.n for r in names.orderBy(natural_key("n"), "n").collect()] == ["a2", "x1b", "x009", "x9", "x10"]
    tags = spark.createDataFrame([("I-PER",), ("B-PER",), ("B-ORG",)], "t string")
    assert [r.t for r in tags.orderBy(label_key("t")).collect()] == ["B-ORG", "B-PER", "I-PER"]


def test_natural_key_of_long_numbers(spark):
    """Numbers beyond the width keep their value; equal values keep equal keys."""
    want = ["x9", "x" + "1" * 20, "x" + "9" * 20, "x" + "9" * 20 + "a", "x1" + "0" * 20, "x" + "1" * 21, "x2" + "0" * 20, "x1" + "0" * 30, "xa"]
    df = spark.createDataFrame([(n,) for n in reversed(want)], "n string")
    assert [r.n for r in df.orderBy(natural_key("n")).collect()] == want
    assert df.select(natural_key("n").alias("k")).distinct().count() == len(want)
    same = spark.createDataFrame([("x" + "1" * 25,), ("x000" + "1" * 25,)], "n string")
    assert same.select(natural_key("n").alias("k")).distinct().count() == 1
    assert spark.createDataFrame([("x07y",)], "n string").select(natural_key("n").alias("k")).first().k == "x" + "0" * 19 + "7y"
