"""Lexicons, clustering, domains, splits, gazetteer files."""

import random
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from tagweave.operators import cluster, domain, phrases, splits
from tagweave.sources import gazetteer


def plain_matches(tokens, lexicon):
    longest = max(len(p.split()) for p in lexicon)
    found = []
    for i in range(len(tokens)):
        for n in range(longest, 0, -1):
            p = " ".join(tokens[i : i + n])
            if i + n <= len(tokens) and p in lexicon:
                found.append((i, i + n, p))
                break
    kept = []
    for a, b, p in sorted(found, key=lambda m: m[0] - m[1]):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, p))
    return sorted(kept)


def test_longest_matches(spark):
    rnd = random.Random(2)
    lexicon = ["a", "a b", "b c d", "d a", "c", "Las Vegas", "North Las Vegas"]
    docs = [["Toronto", "to", "North", "Las", "Vegas", "USA"]] + [[rnd.choice("abcdx") for _ in range(rnd.randint(1, 14))] for _ in range(200)]
    tokens = spark.createDataFrame([(d, i, t) for d, ts in enumerate(docs) for i, t in enumerate(ts)], "doc_id long, pos int, token string")
    lex = spark.createDataFrame([(p,) for p in lexicon + [None]], "name string")
    got = {}
    for r in phrases.longest_matches(tokens, lex).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.phrase))
    assert all(sorted(got.get(d, [])) == plain_matches(ts, lexicon) for d, ts in enumerate(docs))
    joined = {}
    for r in phrases.longest_matches(tokens, lex, broadcast_bytes=0).collect():
        joined.setdefault(r.doc_id, []).append((r.start, r.end, r.phrase))
    assert {d: sorted(m) for d, m in joined.items()} == {d: sorted(m) for d, m in got.items()}
    seqs = spark.createDataFrame([(d, ts) for d, ts in enumerate(docs)] + [(9999, None)], "doc_id long, tokens array<string>")
    assert phrases.longest_matches(seqs, lex).count() == sum(map(len, got.values()))
    flags = {r.pos: (r["B-g"], r["I-g"], r.g) for r in phrases.phrase_flags(tokens, lex, "g").where("doc_id = 0").collect()}
    assert flags == {0: (None,) * 3, 1: (None,) * 3, 2: (True, None, True), 3: (None, True, True), 4: (None, True, True), 5: (None,) * 3}
    assert phrases.longest_matches(tokens, lex.limit(0)).count() == 0
    low = phrases.phrase_flags(tokens, spark.createDataFrame([("LAS vegas",)], "name string"), "g", lower=True)
    assert low.where("g").count() == 2


def plain_best(dist, types, exempt):
    def score(t):
        groups, cur = [], [types[0]]
        for d, k in zip(dist[1:], types[1:]):
            if d > t:
                groups.append(cur)
                cur = []
            cur.append(k)
        groups.append(cur)
        return sum(sum(c if c == 1 or k in exempt else -c for k, c in Counter(g).items()) - 1 for g in groups)

    cands = sorted(set(dist[1:]), reverse=True)
    return [(t, score(t)) for t in cands] or [(0, 0)]


def test_all_thresholds_against_loop(spark):
    rnd = random.Random(4)
    for _ in range(500):
        n = rnd.randint(1, 14)
        dist, types = [rnd.randint(0, 6) for _ in range(n)], [rnd.choice("ABC") for _ in range(n)]
        exempt = frozenset(rnd.sample("ABC", rnd.randint(0, 2)))
        assert cluster.all_scores(dist, types, exempt) == plain_best(dist, types, exempt)
    assert cluster.all_scores([], [], frozenset()) == []


def test_positions_and_groups(spark):
    # doc 1: two contacts far apart; doc 2: one entity; doc 3: none
    rows = []
    for i, (node, parent, tok, tag) in enumerate([(1, 1, "A", "B-ORG"), (1, 1, "x", "O"), (2, 2, "1", "B-TEL"), (5, 5, "y", "O"), (5, 5, "z", "O"), (6, 6, "B", "B-ORG"), (7, 7, "2", "B-TEL")]):
        rows.append((1, i, node, parent, tok, tag))
    rows += [(2, 0, 1, 1, "Q", "B-ORG"), (3, 0, 1, 1, "n", "O")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, node_id int, parent_node_id int, token string, tag string")
    placed = cluster.positions(df)
    assert [r.place for r in placed.where("doc_id = 1").orderBy("pos").collect()] == [0, 2, 7, 12, 14, 19, 24]
    ents = cluster.entity_distances(placed)
    assert [(r.ent_no, r.entity_type, r.distance) for r in ents.where("doc_id = 1").orderBy("ent_no").collect()] == [(1, "ORG", 0), (2, "TEL", 7), (3, "ORG", 12), (4, "TEL", 5)]
    assert {r.doc_id: (r.threshold, r.score) for r in cluster.best(ents).collect()} == {1: (7, 2), 2: (0, 0)}
    assert sorted((r.doc_id, r.cluster_no, r.text) for r in cluster.entity_groups(placed).collect()) == [(1, 1, "1"), (1, 1, "A"), (1, 2, "2"), (1, 2, "B"), (2, 1, "Q")]


def test_domains(spark):
    d = lambda u: spark.range(1).select(domain.registered_domain(F.lit(u)).alias("d")).first().d
    assert d("http://www.a.b.example.com:80/x?y") == "example.com" and d("//sub.x.co.uk") == "x.co.uk" and d("http://u:p@Shop.DE./") == "shop.de"
    assert d("http://co.uk/") == "" and d("/local") == "" and d("http://10.0.0.1/") == "" and d("mailto:a@b.com") == "" and d(None) == ""
    pages = spark.createDataFrame(
        [
            (1, "<a href='http://x.com/1'>a</a><a href=http://y.com>b</a><a href='http://y.com/2'>c</a>"),
            (2, "<html><head><base href='http://z.org/'></head><a href='http://x.com'>"),
            (3, '<html><head><!-- base href="http://c.net/x" --></head><a href="http://x.com">'),
            (4, "<a href='http://b.com'></a><a href='http://a.com'></a><a href='http://twitter.com'></a><a href='http://twitter.com/2'></a>"),
            (5, None),
            (6, "<!-- <a href='http://x.com'> --><p>none"),
        ],
        "page_id long, html string",
    )
    assert {r.doc_id: r.domain for r in domain.page_domain(pages, "page_id", "html").collect()} == {1: "y.com", 2: "z.org", 3: "c.net", 4: "a.com", 5: "", 6: ""}


def test_splits(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    for size, n in ((1, 1), (0.5, 5), (None, 2), (3, 3), (0, 10), (99, 10)):
        got = splits.split_noshuffle(df, "k", size)
        assert sorted(r.k for r in got.where("is_test").collect()) == list(range(10 - n, 10)), size
    ties = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k long")
    assert splits.split_noshuffle(ties, "k", 2).where("is_test").count() == 2
    big = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"))
    assert splits.split_noshuffle(big, "k", 12_345).where("is_test").agg(F.min("k"), F.count("*")).first() == (60_000 - 12_345, 12_345)
    gaps = spark.createDataFrame([(None,), (None,), (1,), (2,), (3,)], "k long")
    for size, want in ((2, [2, 3]), (3, [1, 2, 3]), (4, [None, 1, 2, 3])):
        got = [r.k for r in splits.split_noshuffle(gaps, "k", size).where("is_test").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    groups = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 3 + [("d",)], "g string")
    assert {r.g: r.fold for r in splits.group_folds(groups, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert splits.hash_folds(groups, "g", 3).select("g", "fold").distinct().count() == 4


def test_gazetteer_files(spark, tmp_path):
    line = "\t".join(["7", "Bern, Old", "Bern", "Bärn,Berna,,Bern", "46.9", "7.4", "A", "ADM1", "NA", "", "", "", "", "", "130000", "", "540", "Etc", "2020-01-01"])
    (tmp_path / "XX.txt").write_text(line + "\n" + line.replace("ADM1", "PPL").replace("7\t", "8\t", 1) + "\n", "utf-8")
    with zipfile.ZipFile(tmp_path / "XX.zip", "w") as z:
        z.write(tmp_path / "XX.txt", "XX.txt")
    a = gazetteer.read_geonames(spark, str(tmp_path / "XX.txt"))
    b = gazetteer.read_geonames_zipped(spark, str(tmp_path / "XX.zip"))
    for df in (a, b):
        first = df.orderBy("geonameid").first()
        assert (first.geonameid, first.country_code, first.population, first.dem, first.latitude, first.cc2) == (7, "NA", 130000, 540, 46.9, None)
    lex = gazetteer.build_lexicon(b, ("country_code",), ("ADM1",), lower=True)
    gazetteer.write_lexicon(lex, str(tmp_path / "lex"))
    names = {tuple(r) for r in gazetteer.read_lexicon(spark, str(tmp_path / "lex")).collect()}
    assert names == {("bern", 1, "NA"), (" old", 2, "NA"), ("bärn", 1, "NA"), ("berna", 1, "NA")}
    (tmp_path / "c.txt").write_text("Peru\n\nPeru\n South Korea \n")
    assert sorted(r.name for r in gazetteer.read_phrases(spark, str(tmp_path / "c.txt")).collect()) == ["Peru", "South Korea"]
