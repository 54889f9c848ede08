import pytest

from tagweave.html.annotate import PALETTE, assign, color_of, to_annotated
from tagweave.html.compare import tree_difference
from tagweave.html.loaders import load_annotated, load_inline, load_plain, read_colors
from tagweave.html.tokens import Options, detokenize, remove_markers, tokenize
from tagweave.html.tree import clean, kill_tags, parse, rename_tags, serialize
from tagweave.sources import pages as pg

INLINE = (
    "<!doctype html><title>Ferry</title><h2>Timetable</h2>"
    "<ul><li>Run by <ORG>Northwater <em>Lines</ORG> since 1990</em>, <b>daily</b></li>"
    "<li>From <CITY>Port Selm</CITY></li></ul>"
)
TOKENS = ["Ferry", "Timetable", "Run", "by", "Northwater", "Lines", "since", "1990", "daily", "From", "Port", "Selm"]
TAGS = ["O", "O", "O", "O", "B-ORG", "I-ORG", "O", "O", "O", "O", "B-CITY", "I-CITY"]


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p>a<br>b<p>c", "<html><body><p>a<br>b</p><p>c</p></body></html>"),
        ("<ul><li>a<li>b</ul>c", "<html><body><ul><li>a</li><li>b</li></ul>c</body></html>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<html><body><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></body></html>"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<html><body><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul></body></html>"),
        ("a</b></p>b", "<html><body>ab</body></html>"),
        ("<title>t</title><p>x", "<html><head><title>t</title></head><body><p>x</p></body></html>"),
        ("", "<html><body></body></html>"),
        ("<p x=1 x=2 y>&amp; &eacute; &lt;", '<html><body><p x="1" y="">&amp; é &lt;</p></body></html>'),
        ("<script>a</p>b</script><p>c", "<html><head><script>a</p>b</script></head><body><p>c</p></body></html>"),
        ("<b><i>x</b>y</i>z", "<html><body><b><i>x</i></b>yz</body></html>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<html><body><dl><dt>a</dt><dd>b</dd><dt>c</dt></dl></body></html>"),
    ],
)
def test_recovery(source, want):
    assert serialize(parse(source)) == want
    assert serialize(parse(want)) == want


def test_deep_and_unfinished_pages():
    root = parse("<div>" * 5000 + "x")
    assert [t.token for t in tokenize(root)] == ["x"] and len(serialize(root)) > 10_000
    for s in ("<p", "<!-- x", "<p>a<!--", "<script>x", "</", "&#", "<a href='x"):
        tokenize(parse(s))
    assert parse(b"<meta charset=latin-1><p>caf\xe9").content() == "café"
    assert parse("<p>é".encode()).content() == "é"


@pytest.mark.parametrize("load", [lambda: load_inline(INLINE, {"ORG", "CITY"}), lambda: load_annotated(to_annotated(load_inline(INLINE, {"ORG", "CITY"})))])
def test_tokens_and_tags(load):
    tokens = tokenize(load())
    assert [t.token for t in tokens] == TOKENS and [t.tag for t in tokens] == TAGS
    places = {t.token: (t.node.tag, t.parent.tag, t.is_tail) for t in tokens}
    assert places["Timetable"] == ("h2", "h2", False) and places["daily"] == ("b", "b", False) and places["Run"] == ("li", "li", False) and places["Lines"] == ("em", "em", False)


def test_ignored_elements_and_options():
    s = "<script>a</script>after<p>hello, <!-- c -->x</p><style>b</style>tail<h4>head</h4>"
    assert [t.token for t in tokenize(parse("<body>" + s))] == ["hello", "head"]
    kept = tokenize(parse("<body>" + s), Options(keep_ignored_tail=True, rename={"h4": "h3"}))
    assert [t.token for t in kept] == ["after", "hello", "x", "tail", "head"] and kept[-1].node.tag == "h3"
    assert [t.token for t in tokenize(parse("<p>a <i>b</i> c"), Options(kill={"i"}))] == ["a", "b", "c"]
    limited = tokenize(load_inline(INLINE, {"ORG", "CITY"}), Options(tagset={"CITY"}))
    assert [t.tag for t in limited] == ["O"] * 10 + ["B-CITY", "I-CITY"]
    with pytest.raises(ValueError):
        tokenize(parse("<p>__START_A__ x __END_B__"))
    with pytest.raises(ValueError):
        load_inline("<p>", None)


def test_detokenise_round_trip():
    root = load_plain(INLINE.replace("<ORG>", "").replace("</ORG>", "").replace("<CITY>", "").replace("</CITY>", ""))
    tokens = tokenize(root)
    marked = detokenize(root, tokens, TAGS)
    again = tokenize(marked)
    assert [t.token for t in again] == TOKENS and [t.tag for t in again] == TAGS
    assert [t.token for t in tokenize(remove_markers(marked))] == TOKENS
    assert detokenize(parse(""), [], []) is None
    with pytest.raises(ValueError):
        detokenize(root, tokens, TAGS[:-1])


SPAN = '<span wa-id="{}" wa-type="{}" wa-subtypes="" style="color:#000000; background-color:{};" class="WebAnnotator_{}">{}</span>'


def test_annotation_skips_comments_scripts_and_blanks():
    org = lambda s: SPAN.format(0, "ORG", "#33CCFF", "ORG", s)
    root = parse("<body> __START_ORG__ a<!--c--><script>x</script>\n<i>d</i>b __END_ORG__ cool</body>")
    assert to_annotated(root) == (
        f"<html><body>{org('a')}<!--c--><script>x</script>\n<i>{org('d')}</i>{org('b')}cool</body>"
        '<wa-color id="WA-color-0" bg="#33CCFF" fg="#000000" class="WebAnnotator_ORG" type="ORG"></wa-color></html>'
    )
    with pytest.raises(ValueError):
        to_annotated(parse("<p> __START_A__ x"))
    two = to_annotated(parse("<p> __START_A__ x __END_A__  &amp; __START_B__ y __END_B__ </p>"))
    assert two.count("<span") == 2 and "</span> &amp;<span" in two


def test_titles_base_and_colors():
    out = to_annotated(parse("<head><title> __START_ORG__ A __END_ORG__  b</title></head><body><p>x</body>"), url="http://a.example/?a&b")
    assert '<head><base href="http://a.example/?a&amp;b"><title>A b</title></head>' in out and "<wa-title style=" in out
    back = load_annotated(out)
    assert [(t.token, t.tag) for t in tokenize(back)] == [("A", "B-ORG"), ("b", "O"), ("x", "O")] and serialize(back).count("wa-") == 0
    assert read_colors(parse(out)) == {"ORG": ("#000000", "#33CCFF", 0)}
    assert "<base" in to_annotated(parse("<body>x"), url="http://q") and to_annotated(parse("<base href=x><p>"), url="http://q").count("<base") == 1
    colors = {}
    assert [assign(colors, f"T{i % 20}")[2] for i in range(25)] == [*range(20), *range(5)]
    assert color_of(15) == PALETTE[15] and color_of(99) == color_of(99) and len(color_of(99)[1]) == 7


def test_split_spans_and_unknown_types():
    s = '<p><span wa-id="8" wa-type="ORG">North</span><span wa-id="8" wa-type="ORG">water</span> <span wa-id="9" wa-type="X"><b>runs</b></span> it<wa-color type="ORG"></wa-color>'
    assert [(t.token, t.tag) for t in tokenize(load_annotated(s, {"ORG"}))] == [("Northwater", "B-ORG"), ("runs", "O"), ("it", "O")]
    assert ("runs", "O") in [(t.token, t.tag) for t in tokenize(load_annotated(s))]


def test_cleaning_and_surgery():
    s = "<body><iframe>fall</iframe>back<object><param>alt</object><applet>x</applet><?pi x><style>s</style><!--c--><script>j</script>end"
    assert serialize(clean(parse(s))) == "<html><body>fallbackalt<style>s</style><!--c--><script>j</script>end</body></html>"
    assert serialize(load_plain(s, strict=True)) == "<html><body>fallbackaltend</body></html>"
    root = parse("<p>a <i>b<b>c</b>d</i> e</p>")
    kill_tags(root, {"i"})
    assert serialize(root) == "<html><body><p>a b<b>c</b>d e</p></body></html>"
    kill_tags(root, {"b"}, keep_child=False)
    rename_tags(root, {"p": "div"})
    assert serialize(root) == "<html><body><div>a bd e</div></body></html>"


def test_differences():
    a, b = parse("<p>a<b>x</b>"), parse("<p>a<b>y</b>")
    assert tree_difference(a, parse("<p> a <b>x</b>")) is None
    assert tree_difference(a, b) == ("0:body/0:p/0:b/", "text: x / y")
    assert tree_difference(a, b, texts=False) is None
    assert tree_difference(parse("<p><i>"), parse("<p><b>"))[1].startswith("tag")
    assert tree_difference(parse("<p id=1>"), parse("<p id=2>"))[1].startswith("attributes")
    assert tree_difference(parse("<p>"), parse("<p></p><p>"))[1].startswith("children")


def test_page_operators(spark, tmp_path):
    rows = [(1, INLINE), (2, None), (3, ""), (1, INLINE), (4, "<p>" + "word " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as tag", "2 as pos")
    load = pg.loader("inline", {"ORG", "CITY"})
    t = pg.page_tokens(df, "page_id", "html", load=load)
    one = t.where("doc_id = 1").collect()
    assert len(one) == 2 * len(TOKENS) and sorted({(r.pos, r.token, r.tag) for r in one}) == [(i, *x) for i, x in enumerate(zip(TOKENS, TAGS))]
    assert t.where("doc_id = 4").count() == 20_000 and t.where("doc_id in (2, 3)").count() == 0 and pg.page_tokens(df.limit(0), "page_id", "html").count() == 0
    n = pg.page_nodes(df.where("page_id = 3"), "page_id", "html").orderBy("node_id").collect()
    assert [(r.tag, r.parent_id, r.depth, r.ancestors) for r in n] == [("html", None, 0, ["html"]), ("body", 0, 1, ["html", "body"])]
    plain = spark.createDataFrame([(1, "<p>Northwater Lines in Bern"), (2, "<p>none")], "page_id long, html string")
    tags = spark.createDataFrame([(1, 0, "B-ORG"), (1, 1, "I-ORG"), (1, 2, "O"), (1, 3, "B-CITY")], "doc_id long, pos long, tag string")
    out = {r.doc_id: r.html for r in pg.annotate_pages(plain, tags, "page_id", "html").collect()}
    assert [(t.token, t.tag) for t in tokenize(load_annotated(out[1]))] == [("Northwater", "B-ORG"), ("Lines", "I-ORG"), ("in", "O"), ("Bern", "B-CITY")] and "<span" not in out[2]
    gate = pg.convert_inline(df.where("page_id = 1").limit(1), "page_id", "html", {"ORG", "CITY"}).first().html
    pair = spark.createDataFrame([(1, INLINE, gate)], "doc_id long, a string, b string")
    assert pg.compare_pages(pair, "doc_id", "a", "b", load, pg.loader("annotated")).count() == 0
    left = pg.page_tokens(pair, "doc_id", "a", load=load)
    assert pg.compare_tokens(left, pg.page_tokens(pair, "doc_id", "b", load=pg.loader("annotated"))).count() == 0
    assert pg.compare_tokens(left, left.where("pos <> 2")).count() == 1
    for name in ("p10.html", "p9.html"):
        (tmp_path / name).write_text("<p>" + name)
    got = pg.in_order(pg.read_pages(spark, str(tmp_path / "*.html"))).collect()
    assert [r.html for r in got] == ["<p>p9.html", "<p>p10.html"]
    (tmp_path / "b.htm").write_bytes(b"<meta charset=latin-1><p>caf\xe9")
    assert [r.token for r in pg.page_tokens(pg.read_pages(spark, str(tmp_path / "b.htm"), None), "path", "html").collect()] == ["café"]


def test_loader_choice():
    with pytest.raises(ValueError):
        pg.loader("inline")
