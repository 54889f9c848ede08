import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import pii
from tagweave.llm.pii import GIVEN_SHARE, LABELS, LEAST_SHARE, Knowledge, _counted, _kept, _pairs, _tag_counts, find_rows, fit, is_full_name, label_documents, number_shape, propagate, redact, redact_rows, train, units, zones

GIVEN = ["Marta", "Peter", "Yusuf", "Zoë", "Jürgen"]
FAMILY = ["Kalzeth", "Drougrin", "Wistea", "Skobioft", "Tionmar", "Beluft", "Marest", "Graizea", "Hopeand", "Nostup", "Fliorom", "Saivair", "Zamsis", "Gioven"]


def make(rnd):
    g, f = rnd.choice(GIVEN), rnd.choice(FAMILY) + rnd.choice(["", "", "-" + rnd.choice(FAMILY)])
    name = rnd.choice([f"{g} {f}", f"{f.upper()}, {g}", f"{g[0]}. {f}", f"{g} {rnd.choice('ABM')}. {f}", f"{g} van der {f}", f"{rnd.choice(['Viondrax', 'Custe'])} {f}"])
    phone = rnd.choice(["+44 20 7946 0167", "(276) 555-0129", "0999 / 555 152-82", "+999 72\xa0555\xa0101", "020 7946 0155"])
    ident = rnd.choice(["X8721109", "000-79-6691", "QQ 53 07 24 C", "994135/5013", "00 172 468 402"])
    mail = rnd.choice(["desk.kalzeth@mail.wefiom.example", "info [at] nilk [dot] test", "j-beluft (at) post.skah.invalid", "MARTA@NILK.TEST", "a at b-mail dot test"])
    street = rnd.choice(["107a Old Gupeilk Blvd", "96 bis, avenue Trimgreis", "Boleicandstraße 215", "Calle Triokio 61", "C/ Vurart, 84b", "Am Baitas-Ufer 119a", "94 Stamhe St."])
    piece = rnd.choice([("name", name, f"Dr. {name} runs Accounts."), ("name", name, f"Contact person: {name}."), ("name", name, f"Ansprechpartner: {name}. Die Straße über Bern ist gesperrt."), ("name", name, f"Signed: {name} About 20 people live here."),
        ("phone", phone, f"Tel. {phone} after 14:30."), ("id_number", ident, f"Holder of passport {ident}, please come by."), ("id_number", ident, f"Steuer-ID {ident} liegt bei uns."), ("email", mail, f"Write to {mail}."), ("street", street, f"Find us at {street}, Dirkrol.")])
    return piece


FILL = ["Kalzeth & Sons share the workshop.", "Invoice no. 000-10179-11 is paid.", "Order ref. 2010-44-34021 came on 1958-03-12.", "Item code 978-0-35819-65-1 is out.", "Questions on Accounts are answered.", "Follow @druvipea for news.", "The road from Drougrinford is closed.", "Open Monday 9:00-17:30, room 14."]


def documents(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        picked = [make(rnd) for _ in range(rnd.randint(0, 3))]
        parts = [s for _, _, s in picked] + rnd.sample(FILL, 3)
        rnd.shuffle(parts)
        out.append((rnd.choice([" ", "\n"]).join(parts), {(k, t) for k, t, _ in picked}))
    return out


PHONES = ["+44 20 7946 0{}", "(276) 555-0{}", "0999 / 555 {}-82", "+999 72\xa0555\xa0{}", "020 7946 0{}"]


def tagged_blocks(rnd, n):
    """Blocks of every tagged kind, and blocks of none."""
    out = []
    for _ in range(n):
        g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
        name = rnd.choice([[g, f], [g, f], [f.upper(), ",", g], [g[0] + ".", f], [rnd.choice(["Viondrax", "Custe"]), f]])
        phone = rnd.choice(PHONES).format(rnd.randint(100, 199)).split(" ")
        street = rnd.choice([f"{rnd.randint(2, 99)} Old {f} Road", f"{f}straße {rnd.randint(2, 99)}", f"Calle {f} {rnd.randint(2, 99)}", f"{rnd.randint(2, 99)}a {f} Street"]).split()
        mail = rnd.choice([f"desk.{f.lower()}@{g.lower()}.example", f"{g.lower()}@{f.lower()}.test"])
        kind = rnd.randint(0, 5)
        if kind == 0:
            out.append(([*name, ",", "Director"], ["B-PER", *["I-PER"] * (len(name) - 1), "O", "B-FUNC"]))
        elif kind == 1:
            out.append((["Tel.", *phone], ["O", "B-TEL", *["I-TEL"] * (len(phone) - 1)]))
        elif kind == 2:
            out.append(([*street, ",", "10115", f + "ford"], ["B-STREET", *["I-STREET"] * (len(street) - 1), "O", "B-ZIPCODE", "B-CITY"]))
        elif kind == 3:
            out.append((["E-mail:", mail], ["O", "B-EMAIL"]))
        elif kind == 4:
            words = f"{f} & Sons of Upper {f} sent order 2010-44-{rnd.randint(10000, 99999)} from {f}ford {rnd.choice(FAMILY)}".split()
            out.append((words, ["O"] * len(words)))
        else:
            words = f"Look at {f.lower()}.example for New {f} and the {f} College".split()
            out.append((words, ["O"] * len(words)))
    return out


@pytest.fixture(scope="module")
def know():
    return fit(tagged_blocks(random.Random(1), 700), [t for t, _ in documents(300, 2)])


def test_held_out_accuracy(know):
    held = documents(400, 3)
    got = label_documents([t for t, _ in held], know)
    want = [(i, k, t) for i, (_, p) in enumerate(held) for k, t in p]
    have = [(i, k, held[i][0][a:b]) for i, p in enumerate(got) for a, b, k in p]
    hit = len(set(want) & set(have))
    assert hit / len(set(want)) > 0.97 and hit / len(set(have)) > 0.97, (sorted(set(want) - set(have))[:8], sorted(set(have) - set(want))[:8])


def test_redaction_keeps_the_rest(know):
    text = "Dr. Marta Kalzeth runs Accounts.\nTel. (276) 555-0129 &c."
    assert redact(text, label_documents([text], know)[0]) == "Dr. [NAME] runs Accounts.\nTel. [PHONE] &c."
    for t, p in zip(*(lambda d: ([x for x, _ in d], label_documents([x for x, _ in d], know)))(documents(50, 5))):
        rest, at = [], 0
        for a, b, _ in p:
            rest.append(t[at:a])
            at = b
        assert all(r in redact(t, p) for r in rest)


def test_skip_edges_carry_evidence(know):
    """A bare pair of words is a name only because it is titled elsewhere."""
    both = label_documents(["Dr. Custe Wistea runs Accounts. Signed: Custe Wistea"], know)[0]
    assert [k for *_, k in both] == ["name", "name"]


def test_propagation_on_a_tree_is_exact():
    rnd = np.random.default_rng(4)
    L = len(LABELS)
    S, P = rnd.normal(size=(3, L)), rnd.normal(size=(L, L))
    belief = propagate(S, np.array([[0, 1], [1, 2]]), np.array([0, 0]), P[None], rounds=60)
    full = S[0][:, None, None] + S[1][None, :, None] + S[2][None, None, :] + P[:, :, None] + P[None]
    for axis, node in ((0, (1, 2)), (1, (0, 2)), (2, (0, 1))):
        want = np.logaddexp.reduce(np.logaddexp.reduce(full, axis=node[1]), axis=node[0])
        got = belief[axis]
        assert np.allclose(got - got.max(), want - want.max(), atol=1e-6)


def test_name_grammar():
    assert is_full_name(["cap", "cap"]) and is_full_name(["caps", ",", "cap"]) and is_full_name(["initial", "cap"]) and is_full_name(["cap", "particle", "particle", "double"])
    assert not is_full_name(["cap"]) and not is_full_name([]) and not is_full_name(["cap", ",", "cap"])


def test_operators_edge_cases(spark, know):
    long = "word " * 40_000
    rows = [(1, "Tel. (276) 555-0129, (276) 555-0129"), (1, "Tel. (276) 555-0129, (276) 555-0129"), (2, None), (3, ""), (4, long + "Write to a@b.test")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as pii_type", "'y' as redacted")
    found = [tuple(r) for r in find_rows(df, "doc_id", "text", know).collect()]
    assert sorted(found) == [(1, "phone", "(276) 555-0129")] * 2 + [(4, "email", "a@b.test")]
    out = {r.doc_id: r for r in redact_rows(df, "doc_id", "text", know).collect()}
    assert out[2].redacted is None and out[3].redacted == "" and out[4].redacted == long + "Write to [EMAIL]" and out[1].n_pieces == 2
    assert find_rows(df.limit(0), "doc_id", "text", know).count() == 0


def test_counts_are_alike_at_every_size(spark):
    """Counted over all rows by share: few rows, many rows and long blocks give the same names and shapes."""
    rows = [(["Ana", "Lopez", ",", "Director"], ["B-PER", "I-PER", "O", "O"]), (["LOPEZ", ",", "Greta", *["x"] * 80], ["B-PER", "I-PER", "I-PER", *["O"] * 80]), (["Mill", "Lane", "Mill", "Mill"], ["B-PER", "I-PER", "O", "O"]), ([None, "Omar", "Stone"], ["O", "B-PER", "I-PER"]), (["Tel", "(", "030", ")", "123-456"], ["O", "B-TEL", *["I-TEL"] * 3]), (["12-34567", "12-34567"], ["B-TEL", "O"]), (["98-76543", ",", "11-22334"], ["O", "O", "O"])]
    want = frozenset({"Ana", "Greta", "Omar"}), frozenset({"(999)999-999"})
    counts = _tag_counts(rows)
    assert (_kept(counts, "g", GIVEN_SHARE, LEAST_SHARE), _kept(counts, "s", GIVEN_SHARE, LEAST_SHARE)) == want
    for times in (1, 30):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * times)], "block_id long, tokens array<string>, tags array<string>")
        counts = _counted(df.select("tokens", "tags"), lambda b: _tag_counts(_pairs(b)), {"g": GIVEN_SHARE, "s": GIVEN_SHARE}, LEAST_SHARE)
        assert (_kept(counts, "g", GIVEN_SHARE, LEAST_SHARE), _kept(counts, "s", GIVEN_SHARE, LEAST_SHARE)) == want


def test_training_on_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(documents(120, 7))] + [(1000, None), (1001, "")], "doc_id long, text string")
    blocks = spark.createDataFrame([(i, *b) for i, b in enumerate(tagged_blocks(random.Random(5), 300))] + [(5000, None, None), (5001, [], [])], "block_id long, tokens array<string>, tags array<string>")
    know = train(docs, "doc_id", "text", blocks)
    held = documents(100, 8)
    assert know.given >= set(GIVEN) and "999 9999 9999" in know.shapes
    know.save(spark, str(tmp_path / "m"))
    again = Knowledge.load(spark, str(tmp_path / "m"))
    texts = [t for t, _ in held]
    assert label_documents(texts, know) == label_documents(texts, again) and again.skip == know.skip
    bare = train(docs.limit(0), "doc_id", "text")
    assert label_documents(["Dr. Marta Kalzeth"], bare) is not None


def test_candidates_outside_all_lists(know):
    """Unseen titles, given names, digit shapes and labels are candidates."""
    for text, piece, kind in [("Greetings from Qorba Velik here", "Velik", "word"), ("Managing Partner Xenobia van der Quell", "Quell", "word"), ("at 030 1234567 daily", "030 1234567", "number"), ("the code K77 12345 B came", "K77 12345 B", "number"), ("call +49 30 123456 now", "+49 30 123456", "number")]:
        assert any(n.text == piece and n.kind == kind for n in zones(text, know)), text
    long = " ".join(f"Wo{chr(97 + i)}" for i in range(20))
    assert [n.text for n in zones(long, know)] == long.split()


def test_unseen_telephone_formats(know):
    """Formats that no tagged block has: recall and precision."""
    unseen = ["+81 3-1234-5678", "+972 3 123 4567", "+61 2 9374 4000", "+91 98765 43210", "+49 30 123456", "+420 224 811 111", "+351 21 123 4567"]
    assert not {number_shape(p) for p in unseen} & know.shapes
    for frame in ("Tel. {} after 14:30.", "Call {} today.", "Fax: {}"):
        texts = [frame.format(p) for p in unseen]
        assert [[t[a:b] for a, b, k in p if k == "phone"] for t, p in zip(texts, label_documents(texts, know))] == [[p] for p in unseen]
    none = ["Order ref. 2010-44-34021 came.", "Item code 978-0-35819-65-1 is out.", "Invoice no. 000-10179-11 is paid."]
    assert label_documents(none, know) == [[], [], []]


def test_unseen_titles_and_languages():
    """Contexts are learned from the texts, so titles of any language count
    once known given names stand behind them; none is listed."""
    rnd = random.Random(9)
    titles = ["Signora {}.", "Pan {} odpowiada.", "Kontakt: {}.", "Fru {} svarer.", "Parlate con {} oggi."]
    family = lambda: "".join(rnd.choice(["bra", "ko", "zi", "mel", "tur", "vash", "ond", "iki"]) for _ in range(4)).capitalize()
    texts = [f"Il museo {family()} {family()} apre. " + rnd.choice(titles).format(f"{rnd.choice(GIVEN)} {family()}") for _ in range(300)]
    texts += [f"Il museo {family()} {family()} apre. " + rnd.choice(titles).format(f"{family()} {family()}") for _ in range(100)]
    know = fit(tagged_blocks(random.Random(2), 500), texts)
    for t in titles:
        text = "Il museo Grande Velia apre. " + t.format("Ildiko Brumast")
        assert [text[a:b] for a, b, k in label_documents([text], know)[0] if k == "name"] == ["Ildiko Brumast"], text


def test_long_addresses_and_negatives(know):
    local = ".".join(["part"] * 60)
    text = f"Write to {local}@nilk.test or look at kalzeth.example."
    assert [text[a:b] for k, a, b in units(text, frozenset()) if k == "email"][0] == f"{local}@nilk.test"
    assert [text[a:b] for a, b, k in label_documents([text], know)[0]] == [f"{local}@nilk.test"]


def test_a_spelling_is_worked_out_once(know, monkeypatch):
    """Words of runs are looked up, not worked out again at every place."""
    calls, folded = Counter(), pii._folded
    monkeypatch.setattr(pii, "_folded", lambda w: (calls.update([w]), folded(w))[1])
    got = label_documents(["Dr. Marta Zelbrath runs Accounts.", "The road to Qorwin Hill is closed."] * 50, know)
    assert got[0] == [(4, 18, "name")] and got[2:] == got[:2] * 49
    assert calls["Zelbrath"] == calls["Qorwin"] == 1


def test_table_of_words_is_bounded(know, monkeypatch):
    texts = [t for t, _ in documents(60, 11)]
    want = label_documents(texts, know)
    monkeypatch.setattr(pii, "WORDS_HELD", 3)
    pii._WORDS.clear()
    assert label_documents(texts, know) == want and 0 < max(map(len, pii._WORDS)) <= 3


ODD = ["&nbsp;", "~", "\xa0", "\n", "\n\n", "İ", "ſ", "K", "ΑΣ ", ":", "–", "-", ".", ", ", "(", ")", " at ", "(at)", " dot ", "@", "&#64;", "12", "7:30", "9:00–18:30", "3:5", "10:30 20", "1:2:3 4", "٣:٤٥", "C/ Vurart, 84b", "Calle ", "Kalzethstraße 5", "Am Beluft-Ufer 9", " Beluft Allee 12a", "SSN: ", "passport no. ", "numéro de foo ", "identité ", "Steuer-ID ", "Dr. ", "X 12345", "39393", "(030) 1", "Marta Kalzeth", "the road ", " a", "b.test"]


def test_short_ways_agree_with_long_ones():
    rnd = random.Random(6)
    for _ in range(2000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 25)))
        times = lambda a, b: b - a < 3 and (text[b : b + 1] == ":" or text[a - 1 : a] in (":", "–") and a)
        digits = [m.span() for m in pii.DIGITS.finditer(text) if not times(*m.span())]
        assert [m.span() for m in pii._TIMES_OR_DIGITS.finditer(text) if not m.lastindex and not times(*m.span())] == digits, text
        assert pii._EMAIL_SIGNS.search(text) or not pii._EMAIL_HINT.search(text), text
        for a in range(len(text) + 1):
            back = re.split("\n\n", text[max(0, a - 40) : a].lower().replace("\xa0", " "))[-1] if a else ""
            long = ["^", "^", "^", *pii._TOKEN.findall(pii._BLANKS.sub(" ", back) if "&" in back or "~" in back else back)][-3:]
            assert pii._outside(text, a) == long, (text, a)
            assert pii._id_label(text, a) == (pii.ID_LABEL.search(text, max(0, a - 60), a) is not None), (text, a)


def test_lists_by_flat_values():
    rows = [["a", None, "bé"], [], ["c"], ["d", ""]]
    column = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    assert pii._lists(column) == rows and pii._lists(column.slice(0, 0)) == []


def test_propagation_by_kinds_of_edges():
    """Edges of several potentials, in any order, give what each edge by itself gives."""
    rnd = np.random.default_rng(8)
    S, P = rnd.normal(size=(6, len(LABELS))), rnd.normal(size=(3, len(LABELS), len(LABELS)))
    edges, kinds = np.array([[0, 1], [1, 2], [0, 2], [3, 4], [2, 3]]), np.array([2, 0, 1, 0, 2])
    belief, messages = S.copy(), {}
    both = [(a, b, P[k]) for (a, b), k in zip(edges.tolist(), kinds)] + [(b, a, P[k].T) for (a, b), k in zip(edges.tolist(), kinds)]
    for _ in range(6):
        new = {}
        for a, b, potential in both:
            m = np.log(np.exp(belief[a] - messages.get((b, a), 0)) @ np.exp(potential))
            new[a, b] = 0.3 * messages.get((a, b), 0) + 0.7 * (m - m.max())
        messages = new
        belief = S + np.array([sum((m for (_, b), m in messages.items() if b == i), np.zeros(len(LABELS))) for i in range(6)])
    assert np.allclose(propagate(S, edges, kinds, P), belief)
