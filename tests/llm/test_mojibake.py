import random

import pytest

from tagweave.llm.mojibake import Repairer, SourceModel, count_words, damaged, verdicts

WORDS = (
    "Straße große schließt für über Geöffnet Geschäftsführer fermée même l’été L’été dépôt près gérante à la cour – “cosy” café … € año niño"
    " Muñoz Flêiskrairn Kröuth Předrost Lůgelby Москва Берлин Ростов-на-дону Αθηνα Κορινθος 東京 大阪 サカナ ヌメリ Réservations después España"
).split()
PLAIN = "the harbour office in is open for season Monday Library Works and Sons carries name class count town north bridge".split()


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return SourceModel(count_words([rnd.choice(WORDS + PLAIN) for _ in range(60_000)]))


def test_clean_words_of_any_script_stay(model):
    judge = Repairer(model).judge
    assert not [w for w in WORDS + PLAIN + ["12°", "O’Neill", "М", "À"] if judge(w)[0]]


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r"])
def test_utf8_read_wrongly_comes_back(model, codec):
    judge = Repairer(model).judge
    for w in WORDS:
        if w.isascii():
            continue
        try:
            bad = w.encode().decode(codec)
        except UnicodeDecodeError:
            continue
        flag, back = judge(bad)
        assert flag and back == w, (codec, w, bad, back)


def test_twice_damaged(model):
    bad = "für".encode().decode("cp1252").encode().decode("cp1252")
    assert Repairer(model).judge(bad) == (True, "für")


@pytest.mark.parametrize("right,wrong,word", [("cp1252", "mac_roman", "Geschäftsführer"), ("cp1252", "cp1251", "Geöffnet"), ("cp1252", "cp850", "año"), ("cp1252", "cp437", "–"), ("koi8-r", "latin-1", "Москва")])
def test_one_byte_tables(model, right, wrong, word):
    flag, back = Repairer(model).judge(word.encode(right).decode(wrong))
    assert flag and back == word


def test_lost_bytes_are_filled_by_the_model(model):
    judge = Repairer(model).judge
    assert judge("f�r") == (True, "für")
    assert judge("schlie�t") == (True, "schließt")
    assert judge("Gesch�ftsf�hrer") == (True, "Geschäftsführer")
    assert judge("fÃ�r") == (True, "für")


def test_operator_and_edge_cases(spark):
    text = " ".join(WORDS * 30)
    bad = "Geöffnet".encode().decode("cp1252")
    rows = [(1, text, ["a", "b"]), (2, f"x, {bad}; y", [bad]), (2, f"x, {bad}; y", [bad]), (3, None, None), (4, "", []), (5, "f�r", [None, "f�r"]), (6, text * 20 + bad, None)]
    df = spark.createDataFrame(rows, "row_id long, t string, tokens array<string>")
    told = verdicts([(df, "t", "plain"), (df, "tokens", "spoofed")])
    for limit in (1 << 20, 0):  # broadcast and joined
        out = damaged(df, "row_id", "t", told, "plain", "fixed", limit).collect()
        assert sorted(r.row_id for r in out) == [2, 2, 5, 6]
        assert [r.fixed for r in out if r.row_id == 2] == ["x, Geöffnet; y"] * 2
        assert [r.fixed for r in out if r.row_id == 5] == ["für"]
        assert sorted(r.row_id for r in damaged(df, "row_id", "tokens", told, "spoofed", None, limit).collect()) == [2, 2, 5]
    none = df.limit(0)
    assert damaged(none, "row_id", "t", verdicts([(none, "t", "plain")]), "plain").count() == 0


@pytest.mark.parametrize("codec", ["cp437", "mac_roman", "koi8-r", "cp850", "cp866", "cp1252", "cp1251"])
def test_lost_bytes_under_every_channel(model, codec):
    """A byte of a sequence is lost: first or last, in any channel."""
    judge = Repairer(model).judge
    for word in ("für", "große", "Geöffnet"):
        i = next(k for k, c in enumerate(word) if c > "\x7f")
        lead, tail = (bytes([b]).decode(codec, "replace") for b in word[i].encode())
        for bad in (lead + "�", "�" + tail):
            if bad == "��":
                continue
            flag, back = judge(word[:i] + bad + word[i + 1 :])
            assert flag and back == word, (codec, word, bad, back)


def test_capitals_through_one_byte_tables(model):
    judge = Repairer(model).judge
    for word, right, wrong in (("GEÖFFNET", "cp1252", "mac_roman"), ("FÜR", "cp1252", "cp437"), ("SCHLIEßT", "cp1252", "cp850")):
        bad = word.encode(right).decode(wrong)
        assert judge(bad)[0], bad


def test_word_frequency_decides(model):
    """Two originals fit; the corpus's word wins over the likelier spelling."""
    plain = Repairer(model).judge("ge�ffnet")[1]
    assert Repairer(model).judge("f�r", {"fôr": 0.9})[0]
    assert plain.startswith("ge") and plain.endswith("ffnet")


def test_mostly_lost_words_stay(model):
    assert Repairer(model).judge("���x") == (True, "���x")
    assert Repairer(model).judge("�") == (True, "�")
