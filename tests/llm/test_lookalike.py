import random
import unicodedata

import pytest

from tagweave.llm.lookalike import LOOK_ALIKES, Trie, canonical, find_lookalikes, normalized, skeleton

NAMES = [(1, "Spartzalk Fields"), (2, "Dastgraith"), (3, "Dastgráith"), (4, "Rimấith"), (5, "Vaxnem-Bay"), (6, "Ola"), (7, "Ola Nord"), (8, "L'Orme")]


def disguise(rnd, name):
    out = []
    for c in name:
        r = rnd.random()
        if r < 0.2 and c in LOOK_ALIKES:
            out.append(rnd.choice(LOOK_ALIKES[c]))
        elif r < 0.3 and "!" <= c <= "~":
            out.append(chr(ord(c) + 0xFEE0))
        elif r < 0.4:
            out.append(c + rnd.choice("​‍\xad⁠﻿‎"))
        elif r < 0.5 and c == " ":
            out.append(rnd.choice("\xa0 　 "))
        elif r < 0.6:
            out.append(unicodedata.normalize("NFD", c))
        else:
            out.append(c)
    return "".join(out)


def test_disguised_names_are_found_whole_and_within():
    rnd, trie = random.Random(2), Trie(NAMES)
    for _ in range(3000):
        ident, name = rnd.choice(NAMES)
        bad = disguise(rnd, name)
        assert [k for k, _, _ in trie.whole(bad)] == [ident], ascii(bad)
        found = trie.within(f"près de {bad}, x")
        assert (ident, name) in [(k, n) for _, _, k, n in found]
        span = next((a, b) for a, b, k, _ in found if k == ident)
        assert f"près de {bad}, x"[slice(*span)] == bad
        assert normalized(bad) == name


def test_what_looks_different_is_not_found():
    trie = Trie(NAMES)
    for text in ("Dästgraith", "DASTGRAITH", "Dastgraithe", "Dastgraith Nord", "Vaxnem Bay", "Rimâith", "", " "):
        assert not trie.whole(text), text
    assert [k for *_, k, _ in trie.within("x Olа Nord")] == [6, 7]
    assert not trie.within("xOlа") and not trie.within("Olа-Nord") and not trie.within("Olа́")


def test_budget_counts_visible_edits():
    trie = Trie(NAMES)
    assert {(k, c) for k, _, c in trie.whole("Dаstgreith", 1)} == {(2, 1), (3, 1)}
    assert {(k, c) for k, _, c in trie.whole("Dаstgraith", 1)} == {(2, 0), (3, 1)}
    assert {k for k, _, c in trie.whole("Vaxnm-Bay", 1)} == {5} and {k for k, _, c in trie.whole("Vaxnemm-Bay", 1)} == {5}
    assert not trie.whole("Vxnm-Bay", 1)


def test_operator_both_ways_and_edge_cases(spark):
    rnd = random.Random(3)
    names = spark.createDataFrame([*NAMES, (9, None)], "name_id long, name string")
    rows = [(i, disguise(rnd, n), ["in", *disguise(rnd, n).split(" "), "."]) for i, (_, n) in enumerate(NAMES * 5)]
    rows += [(100, "Ola", ["Ola"]), (101, None, None), (102, "", []), (103, " Ola", [None, "Ola"]), (104, "О" * 50_000, ["x" * 50_000 + "é"]), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "row_id long, main_name string, tokens array<string>").selectExpr("*", "'c' as field_name", "1 as name_id")
    a = {tuple(r) for r in find_lookalikes(df, "row_id", ["main_name", "tokens"], names).collect()}
    b = {tuple(r) for r in find_lookalikes(df, "row_id", ["main_name", "tokens"], names, broadcast_bytes=0).collect()}
    assert a == b and (103, "main_name", 6) in a and not [r for r in a if r[0] in (100, 101, 102, 104)]
    want = {(i, "main_name", k) for i, (k, n) in enumerate(NAMES * 5) if rows[i][1] != n}
    assert want <= a
    assert find_lookalikes(df.limit(0), "row_id", ["main_name"], names).count() == 0
    assert find_lookalikes(df, "row_id", ["main_name"], names.limit(0)).count() == 0
    got = {r.row_id: r.canonical for r in canonical(df, "row_id", "main_name", names).collect()}
    assert all(got[i] == n for i, (_, n) in enumerate(NAMES * 5)) and got[101] is None and got[102] == ""


def test_look_of_a_text():
    assert skeleton("Ａﬁ ﬆ") == "Afi st" and skeleton("ệ") == skeleton("ệ") == skeleton("ệ")


def test_canonical_is_alike_for_large_vocabularies(spark):
    rnd = random.Random(7)
    names = spark.createDataFrame([*NAMES, (9, None), (10, " ")], "name_id long, name string")
    rows = [(i, f"près de {disguise(rnd, n)}, {disguise(rnd, 'Ola Nord')}.", ["x", *disguise(rnd, n).split(" "), "é"]) for i, (_, n) in enumerate(NAMES * 4)] + [(90, None, None), (91, "", []), (92, "Ola", ["Ola", None]), (92, "Ola", ["Ola", None])]
    df = spark.createDataFrame(rows, "row_id long, main_name string, tokens array<string>")
    for field in ("main_name", "tokens"):
        a, b = (sorted(map(str, canonical(df, "row_id", field, names, broadcast_bytes=n).collect())) for n in (1 << 25, 0))
        assert a == b and len(a) == len(rows)
    assert any("Spartzalk Fields, Ola Nord." in x for x in map(str, canonical(df, "row_id", "main_name", names, broadcast_bytes=0).collect()))


def test_canonical_query_covers_asciiname(spark, sf):
    from tagweave.llm.queries import p4_canonical

    got = p4_canonical(spark, sf)
    assert got.columns == ["tab_name", "row_id", "field_name", "canonical"]
    assert {(r.tab_name, r.field_name) for r in got.select("tab_name", "field_name").distinct().collect()} == {("geonames", "main_name"), ("geonames", "asciiname"), ("html_blocks", "tokens")}


def test_free_edges_are_walked_on_the_text_itself():
    trie = Trie([(1, "fjord"), (2, "Rimấith")])
    assert [(k, c) for k, _, c in trie.whole("ｆϳ​оrd")] == [(1, 0)]
    # accents in any order and any composition are one edge
    for bad in ("Rima\u0302\u0301ith", "Rim\u00e2\u0301ith", "Rima\u200d\u0302\u0301ith"):
        assert [(k, c) for k, _, c in trie.whole(bad)] == [(2, 0)], ascii(bad)
    assert [(k, c) for k, _, c in trie.whole("Rimâith", 1)] == [(2, 1)]  # a wrong accent is one edit


def test_budget_within_a_text():
    trie = Trie(NAMES)
    text = "near Spartzаlk Fiеlts, x"
    assert not trie.within(text)
    assert [(text[a:b], k) for a, b, k, _ in trie.within(text, 1)] == [("Spartzаlk Fiеlts", 1)]
    assert (100, "t", 1) in {(100, "t", k) for _, _, k, _ in trie.within("Sparzalk Fields", 1)}


def test_budget_of_the_operator(spark):
    names = spark.createDataFrame(NAMES, "name_id long, name string")
    df = spark.createDataFrame([(1, "Dastgreith", ["x", "Vaxnm-Bay"]), (2, "Dastgraith", None)], "row_id long, main_name string, tokens array<string>")
    got = {tuple(r) for r in find_lookalikes(df, "row_id", ["main_name", "tokens"], names, budget=1).collect()}
    assert (1, "main_name", 2) in got and (1, "tokens", 5) in got and (2, "main_name", 2) not in got
    with pytest.raises(ValueError):
        find_lookalikes(df, "row_id", ["main_name"], names, broadcast_bytes=0, budget=1)


def test_rows_do_not_depend_on_the_size_of_the_vocabulary(spark):
    """Names with signs at their ends, names that are odd themselves, signs that
    look like several, and blanks of any kind, walked and joined."""
    names = [(1, "Ola (Nord)"), (2, "Оla"), (3, " Bad Ems"), (4, "A/B/C/D/E"), (5, "1"), (6, "\u200b"), (7, "ガ"), (8, "Ola Nord"), (9, "Vik"), (10, "\u0301x")]
    texts = {
        "Ola": {2}, "Ola\tNord": {8}, "Bad Ems": {3}, "Оla (Nord)": {1}, "A/B/С/D/E": {4}, "⑴": set(), "\u200b": set(), "ｶ\uff9e": {7},
        "\u2028Vіk": set(), " Vіk": {9}, " \u0301x": set(), "Vіk": {9}, "Vik": set(),
    }
    within = {"(\u0301Vіk": {9}, "Vіk⒈": set(), "Ola\tNord": {2, 8}, "Оla (Nord)": {1}, "A/B/С/D/E": {4}, "⑴ 1": set(), "x ｶ\uff9e": {7}}
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, None, [t]) for i, t in enumerate(within)]
    df = spark.createDataFrame(rows, "row_id long, main_name string, tokens array<string>")
    want = {(i, "main_name", k) for i, t in enumerate(texts) for k in texts[t]} | {(100 + i, "tokens", k) for i, t in enumerate(within) for k in within[t]}
    for kind in ("long", "string", "int"):
        known = spark.createDataFrame(names, "name_id long, name string").selectExpr(f"cast(name_id as {kind}) name_id", "name")
        for size in (1 << 25, 0):
            got = {(r[0], r[1], int(r[2])) for r in find_lookalikes(df, "row_id", ["main_name", "tokens"], known, broadcast_bytes=size).collect()}
            assert got == want, (kind, size, got ^ want)
    known = spark.createDataFrame(names, "name_id long, name string")
    for field in ("main_name", "tokens"):
        a, b = (sorted(map(str, canonical(df, "row_id", field, known, broadcast_bytes=n).collect())) for n in (1 << 25, 0))
        assert a == b


def test_random_texts_are_walked_and_joined_alike(spark):
    rnd = random.Random(11)
    signs = [*"abаo0 .,-'(/)\u2019", "\t", "\xa0", "\x1f", "\x85", "\u200b", "\u0301", "\u0302", "\u20dd", "\u2028", "\xbd", "⑴", "℀", "⒈", "ﬁ", "ｶ", "\uff9e", "ガ", "\u3099", "\u3000", "\u0f73"]
    names = [(k, "".join(rnd.choices(signs, k=rnd.randint(0, 4)))) for k in range(60)]
    pool = signs + [n for _, n in names]
    rows = [(i, "".join(rnd.choices(pool, k=rnd.randint(1, 6))), rnd.choices(pool, k=rnd.randint(0, 5))) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, main_name string, tokens array<string>")
    for known in (names, [x for x in names if Trie([x]).odd is False]):
        known = spark.createDataFrame(known, "name_id long, name string")
        a, b = ({tuple(r) for r in find_lookalikes(df, "row_id", ["main_name", "tokens"], known, broadcast_bytes=n).collect()} for n in (1 << 25, 0))
        assert len(a) > 500 and a == b
