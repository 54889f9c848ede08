import random

import pytest

from tagweave.llm.bpe import DEFAULT_VOCABULARY, Encoder, Vocabulary, decode_ids, encode_texts, load_vocabulary, pieces


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(load_vocabulary())


def merged(vocabulary, piece: bytes) -> list[int]:
    """Brute force: merge the lowest-ranked pair until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [(vocabulary.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not ranks or min(ranks)[0] == 1 << 30:
            return [vocabulary.rank[p] for p in parts]
        i = min(ranks)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_against_brute_force_merges(vocabulary):
    rnd = random.Random(3)
    alphabet = "abcdeinorst '.,0123\n\té東🙂ſ́"
    for _ in range(3000):
        piece = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 24))).encode()
        assert list(vocabulary.encode_piece(piece)) == merged(vocabulary, piece)
    for piece in (b"a" * 300, b"\xff\xfe\x00", "ntnt" * 40):
        piece = piece if isinstance(piece, bytes) else piece.encode()
        assert list(vocabulary.encode_piece(piece)) == merged(vocabulary, piece)


def test_against_public_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    from tagweave.llm.bpe import PATTERN

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    mine = Encoder(vocabulary)
    rnd = random.Random(4)
    alphabet = [chr(c) for c in (*range(9, 14), *range(28, 127), 133, 160, 178, 0x2028, 0x2160, 0x661, 0x1D7D9, 0x1F600, 0x10107)]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert mine.encode(text) == other.encode_ordinary(text), ascii(text)
    assert "".join(pieces("a_b  c² x\n")) == "a_b  c² x\n"


def test_every_token_is_made_of_two(vocabulary):
    assert sum(a == i for i, a in enumerate(vocabulary.left)) == 256


def test_round_trip_nulls_and_long_texts(spark):
    rows = [(1, "Straße 東京 🙂"), (2, ""), (3, None), (4, "x" * 100_000), (5, " "), (1, "Straße 東京 🙂")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "ids")
    out = encode_texts(docs, "ids", "text", ids="codes")
    got = out.collect()
    assert [r.codes for r in got if r.ids in (2, 3)] == [[], []]
    back = decode_ids(out, "ids", "codes", DEFAULT_VOCABULARY).collect()
    assert sorted((r.ids, r.text) for r in back) == sorted((i, t or "") for i, t in rows)
    assert encode_texts(docs.limit(0), "ids", "text").count() == 0
