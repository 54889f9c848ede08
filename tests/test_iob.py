import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import chains, iob, markers, metrics, patterns
from tagweave.operators.tokens import text_tokens


def frame(spark, docs):
    return spark.createDataFrame([(d, i, t, g) for d, (toks, tags) in enumerate(docs) for i, (t, g) in enumerate(zip(toks, tags))], "doc_id long, pos int, token string, tag string")


def plain_groups(tags):
    out, prev = [], None
    for i, t in enumerate(tags):
        new = prev is None or t[0] == "B" or (t == "O" and prev != "O") or (t[0] == "I" and (prev == "O" or prev[2:] != t[2:]))
        if new:
            out.append([t if t == "O" else t[2:], i, i])
        out[-1][2] = i
        prev = t
    return [tuple(g) for g in out]


def test_groups_against_loop(spark):
    rnd = random.Random(1)
    docs = []
    for _ in range(300):
        tags = [rnd.choice(["O", "O", "B-A", "I-A", "B-B", "I-B"]) for _ in range(rnd.randint(1, 9))]
        docs.append(([f"w{i}" for i in range(len(tags))], tags))
    got = {}
    for r in iob.groups(frame(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.tag, r.start_pos, r.end_pos))
    assert all(sorted(got[d], key=lambda g: g[1]) == plain_groups(tags) for d, (_, tags) in enumerate(docs))
    with pytest.raises(Exception, match="invalid sequence"):
        iob.groups(frame(spark, [(["a"], ["I-A"])]), strict=True).collect()


def test_encoding(spark):
    docs = spark.createDataFrame([(1, "__START_PER__ John Smith __END_PER__ said __START_X__foo bar __END_X__"), (2, "no markers"), (3, None), (4, "__START_A__ a __START_B__ b c __END_B__ d")], "doc_id long, text string")
    got = {}
    for r in iob.encode(text_tokens(docs, "doc_id", "text")).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.token, r.tag))
    assert got == {
        1: [("John", "B-PER"), ("Smith", "I-PER"), ("said", "O"), ("bar", "B-X")],
        2: [("no", "O"), ("markers", "O")],
        4: [("a", "B-A"), ("b", "B-B"), ("c", "I-B"), ("d", "O")],
    }
    wrong = spark.createDataFrame([(1, "__START_A__ a __END_B__ b")], "doc_id long, text string")
    with pytest.raises(Exception, match="unexpected end"):
        iob.encode(text_tokens(wrong, "doc_id", "text")).collect()
    limited = iob.encode(iob.limit_tags(text_tokens(docs.where("doc_id = 1"), "doc_id", "text"), {"X"}))
    assert [r.tag for r in limited.orderBy("pos").collect()] == ["O", "O", "O", "B-X"]


def test_entities_and_null_tags(spark):
    df = frame(spark, [(["Mr", ".", "X", "(", "a"], ["B-P", "I-P", None, "B-Q", "I-Q"])])
    assert sorted((r.entity_type, r.text) for r in iob.entities(df).collect()) == [("P", "Mr."), ("Q", "(a")]


def test_markers_in_and_out(spark):
    one = spark.createDataFrame([(1, "<ORG>A</org> <City>B</CITY> <ORG class=x>C</ORG>"), (2, None)], "doc_id long, html string")
    got = {r.doc_id: r.x for r in one.select("doc_id", markers.inline_tags_to_markers(F.col("html"), ["ORG", "CITY"]).alias("x")).collect()}
    assert got == {1: " __START_ORG__ A __END_org__   __START_City__ B __END_CITY__  <ORG class=x>C __END_ORG__ ", 2: None}
    with pytest.raises(ValueError):
        markers.inline_tags_to_markers(F.col("html"), None)
    texts = spark.createDataFrame([(1, "John Smith, Bern."), (2, "none"), (3, None)], "doc_id long, text string")
    toks = spark.createDataFrame([(1, 0, 0, 4, "B-PER"), (1, 1, 5, 5, "I-PER"), (1, 2, 12, 4, "B-CITY"), (1, 3, 16, 1, "O")], "doc_id long, pos int, position int, length int, tag string").withColumn("token", F.lit(""))
    out = {r.doc_id: r.text for r in markers.insert_markers(texts, toks).collect()}
    assert out == {1: " __START_PER__ John Smith __END_PER__ ,  __START_CITY__ Bern __END_CITY__ .", 2: "none", 3: None}
    back = spark.createDataFrame([(1, out[1])], "doc_id long, text string")
    assert back.select(markers.remove_markers(F.col("text")).alias("t")).first().t == "John Smith, Bern."
    found = back.select("doc_id", F.inline(markers.find_markers(F.col("text")))).withColumnRenamed("position", "at")
    assert [(r.type, out[1][r.start :][:13], out[1][r.end :][:7]) for r in markers.pair_markers(found).orderBy("k").collect()] == [("PER", "__START_PER__", "__END_P"), ("CITY", "__START_CITY_", "__END_C")]
    with pytest.raises(Exception, match="differs"):
        markers.pair_markers(found.limit(1)).collect()


def test_patterns(spark):
    toks = "hello , John Doe Mary said".split()
    df = spark.createDataFrame([(1, i, t, t[0].isupper(), None if t == "," else t.lower()) for i, t in enumerate(toks)], "doc_id long, pos int, token string, up boolean, low string")
    assert patterns.pattern_name([(-2, "low"), (0, "up"), (1, "up")]) == "low[-2]/up/up[+1]"
    out = patterns.pattern(df, [(-2, "low"), (1, "up")], name="p").orderBy("pos").collect()
    assert [r.p for r in out] == ["?/False", "?/True", "hello/True", "_NA_/True", "john/False", "doe/?"]
    out = patterns.pattern(df, [(-1, "low")], out_value="OUT", name="p").orderBy("pos").collect()
    assert [r.p for r in out] == [None, "hello", "_NA_", "john", "doe", "mary"]


def test_frequencies_and_maps(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "x"), (2, 0, "a", "x"), (2, 1, "a", "y"), (3, 0, "b", "x")], "doc_id long, pos int, name string, value string")
    assert {tuple(r) for r in patterns.document_frequency(df).collect()} == {("a", "x", 2), ("a", "y", 1), ("b", "x", 1)}
    assert patterns.prune(df, 2).count() == 3 and patterns.prune(df, 1).count() == 5 and patterns.prune(df, 3).count() == 0
    assert patterns.feature_names(df) == ["token", "a", "b"]
    m = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3, 'c', 4) AS y")
    assert m.select(patterns.merge_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": 1, "b": 3, "c": 4}
    assert [r.key for r in patterns.combined_keys(m, "y").collect()] == ["b", "c"]
    wide = spark.createDataFrame([(1, 0, "t", True, None)], "doc_id long, pos int, token string, up boolean, n string")
    assert patterns.feature_lines(wide, ["token", "up", "n"]).first().line == "t 1 None"


def test_metrics(spark):
    def run(pairs):
        df = spark.createDataFrame([(d, i, a, b) for d, (x, y) in enumerate(pairs) for i, (a, b) in enumerate(zip(x.split(), y.split()))], "doc_id long, pos int, y_true string, y_pred string")
        return {r.doc_id: r.f1 for r in metrics.bio_f1(df).collect()}, df

    f1, df = run([("B-A I-A O", "B-A I-A O"), ("B-A O", "O O"), ("B-A I-A B-B", "B-A O B-B"), ("O O", "O O"), ("B-A O I-A B-B", "B-A I-A O B-B"), ("I-A B-A", "B-A B-A")])
    assert f1 == {0: 1.0, 1: 0.0, 2: 0.5, 3: 0.0, 4: 1.0, 5: round(2 / 3, 6)}
    report = {r.tag: r for r in metrics.classification_report(df).collect()}
    assert (report["B-B"].precision, report["B-B"].recall, report["B-B"].support) == (1.0, 1.0, 2)
    assert [r.tag for r in metrics.classification_report(df).collect()] == ["B-A", "I-A", "B-B"]
    acc = metrics.sequence_accuracy(df).first()
    assert acc.sequence_accuracy == round(2 / 6, 6)
    with pytest.raises(Exception, match="same length"):
        metrics.bio_f1(df.withColumn("y_pred", F.when(F.col("pos") == 0, F.col("y_pred")))).collect()


def test_chains(spark):
    assert chains.merge_chains([["B-PER", "O"], ["O", "B-FUNC"]]) == ["B-PER", "B-FUNC"]
    assert chains.merge_chains([["B-PER", "I-PER", "O"], ["O", "B-PER", "I-PER"]]) == ["B-PER", "I-PER", "O"]
    assert chains.merge_chains([["B-PER", "I-PER"], ["B-ORG", "I-ORG"]]) == ["B-PER", "I-PER"]
    df = spark.createDataFrame([(1, 0, ["B-P", "O", None]), (1, 1, ["O", "B-F", "I-F"]), (2, 0, ["O"])], "doc_id long, rank int, tags array<string>")
    assert {r.doc_id: r.tags for r in chains.merge_top_n(df).collect()} == {1: ["B-P", "B-F", "I-F"], 2: ["O"]}
    with pytest.raises(Exception, match="length"):
        chains.merge_top_n(spark.createDataFrame([(1, 0, ["O"]), (1, 1, [])], "doc_id long, rank int, tags array<string>")).collect()
