"""Options of the pipeline, the clustering, the phrase search and the domains."""

import pytest
from pyspark.sql import functions as F

from tagweave.functions import features as ft
from tagweave.model.pipeline import TaggingPipeline, contact_pipeline
from tagweave.operators import cluster, domain, iob, patterns, phrases
from tagweave.sources import gazetteer


def tokens(spark, n=12):
    rows = []
    for d in range(n):
        words = [("Mira", "B-PER"), ("of", "O"), ("Port", "B-CITY"), ("Selm", "I-CITY"), (str(1000 + d), "B-ZIPCODE")]
        rows += [(d, i, t, g, 0, len(words), i) for i, (t, g) in enumerate(words)]
    return spark.createDataFrame(rows, "doc_id long, pos long, token string, tag string, chunk_no int, block_len int, index int")


def test_contact_bundle_and_saved_options(spark, tmp_path):
    places = spark.createDataFrame([("Port Selm", "Port Selm", None, "P", "PPL", 9000), ("Northland", None, None, "A", "ADM1", 0)], "main_name string, asciiname string, alternatenames string, feature_class string, feature_code string, population long")
    lexicons = gazetteer.contact_lexicons(places, spark.createDataFrame([("Peru",)], "name string"))
    assert list(lexicons) == ["COUNTRY", "CITY-1000", "CITY-5000", "CITY-15000", "ADM1"]
    assert [lexicons[n].count() for n in lexicons] == [1, 1, 1, 0, 1]
    m = contact_pipeline(lexicons, max_documents=10, min_df=2)
    m.crf.max_iterations = 10
    m.fit(tokens(spark))
    assert {"B-CITY-1000", "I-CITY-5000"} <= set(m.crf.vocabulary) and not any("15000" in f for f in m.crf.vocabulary)
    assert "token=1000" not in m.crf.vocabulary  # in one of all documents only
    out = m.predict(tokens(spark))
    assert out.columns == [*[c for c in tokens(spark).columns if c != "tag"], "tag"] and out.count() == 60
    assert out.where("token = 'Port'").select("tag").distinct().collect()[0].tag == "B-CITY"
    m.save(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        TaggingPipeline().load(spark, str(tmp_path / "m"))
    again = contact_pipeline(lexicons).load(spark, str(tmp_path / "m"))
    assert (again.min_df, again.max_documents, again.patterns) == (2, 10, m.patterns)
    assert sorted(map(str, again.predict(tokens(spark)).collect())) == sorted(map(str, out.collect()))


def test_presets():
    names = [f.__name__ for f in ft.CONTACT_FEATURES]
    assert names == [f.__name__ for f in ft.EXAMPLE_FEATURES] and "looks_like_time" not in names and names[0] == "bias"
    assert "HOURS" in ft.CONTACT_TYPES and "EMAIL" not in ft.CONTACT_TYPES and len(ft.ENTITY_TYPES) == 13


def test_templates_reach_the_model(spark):
    m = TaggingPipeline(token_features=[ft.token_lower], template="u1:%x[-1,lower]/%x[0,lower]\nu2:%x[+1,lower]", columns={"lower": 0}, max_documents=12)
    m.crf.max_iterations = 5
    m.fit(tokens(spark))
    assert m.patterns == [[(-1, "lower"), (0, "lower")], [(1, "lower")]] and not m.crf.T.any()
    assert any(f.startswith("lower[-1]/lower=") for f in m.crf.vocabulary)
    m = TaggingPipeline(token_features=[ft.token_lower], template="b\nu2:%x[+1,lower]", columns={"lower": 0}, max_documents=12)
    m.crf.max_iterations = 5
    assert m.fit(tokens(spark)).crf.T.any()


def test_own_score_of_clusters(spark):
    rows = [(1, i, t, 2 * i + (50 if i > 1 else 0), d) for i, (t, d) in enumerate([("ORG", 5), ("TEL", 4), ("ORG", 60), ("TEL", 4)])]
    ents = spark.createDataFrame([(d, i + 1, t, gap) for d, i, t, _, gap in rows], "doc_id long, ent_no int, entity_type string, distance long")
    assert [tuple(r) for r in cluster.best(ents).collect()] == [(1, 4, 2)]
    most = lambda clusters, threshold, weight=1: weight * max(map(len, clusters))
    assert [tuple(r) for r in cluster.best(ents, score_func=most, score_kwargs={"weight": 2}).collect()] == [(1, 60, 8.0)]
    assert cluster.custom_scores([5], ["a"], most) == [(0, 0.0)] and cluster.custom_scores([], [], most) == []


def test_own_order_and_empty_lexicon(spark):
    seqs = spark.createDataFrame([(1, "a b c d".split())], "doc_id long, tokens array<string>")
    lex = spark.createDataFrame([("a b",), ("b c d",), ("d",)], "name string")
    got = lambda **k: sorted((r.start, r.end) for r in phrases.longest_matches(seqs, lex, **k).collect())
    assert got() == [(1, 4)] and got(broadcast_bytes=0) == [(1, 4)]
    first = lambda m: m[0]
    assert got(order=first) == got(order=first, broadcast_bytes=0) == [(0, 2), (3, 4)]
    assert phrases.longest_matches(seqs, lex.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.longest_matches(seqs, lex.limit(0), required=True)


def test_domains_of_every_suffix(spark):
    cases = {"http://a.b.selm.ch/x": "selm.ch", "https://u@www.selm.co.uk:8080": "selm.co.uk", "//selm.at": "selm.at", "http://localhost/x": "", "http://10.0.0.1/": "", "http://co.uk/": "", "x": "", "http://a.selm.museum.": "selm.museum"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.d for r in df.select("u", domain.registered_domain(F.col("u")).alias("d")).collect()} == cases
    assert df.where("u like '%.ch/x'").select(domain.registered_domain(F.col("u"), ["com"]).alias("d")).first().d == ""


def test_indices_and_pairs(spark):
    t = spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "B-X"), (2, 0, "c", "O")], "doc_id long, pos long, token string, tag string")
    plain, tags = iob.split(t)
    assert plain.columns == ["doc_id", "pos", "token"] and tags.columns == ["doc_id", "pos", "tag"]
    at = spark.createDataFrame([(1, 0, 1, "B-Y"), (1, 1, 1, "I-Y"), (2, 0, 7, "O")], "doc_id long, out_pos long, pos long, tag string")
    assert sorted(map(tuple, iob.from_indices(at, plain).collect())) == [(1, 0, "b", "B-Y"), (1, 1, "b", "I-Y")]
    f = spark.createDataFrame([("s", "X", 1), ("s", "X", 1), ("s", "X", 2), ("s", "Y", 2)], "name string, value string, doc_id long")
    assert sorted(map(tuple, patterns.pair_counts(f).collect())) == [("s", "X", 2, 3), ("s", "Y", 1, 1)]
    assert patterns.prune(f, 2).count() == 3


def test_lines_that_do_not_parse(spark):
    raw = spark.createDataFrame([("7\tA \"x\"\t" + "\t" * 16,), ("a\tb",), (None,)], "raw_line string")
    got = gazetteer.cut_lines(raw).collect()
    assert [(r.geonameid, r.main_name, r._bad) for r in got] == [(7, 'A "x"', None), (None, None, "a\tb"), (None, None, None)]
