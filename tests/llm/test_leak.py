import random

import numpy as np

from tagweave.llm.leak import ItemIndex, Walk, _bloom, _held, edit_distance, find_leaks, words


def brute(docs, items, w):
    grams = lambda t: {tuple(x[i : i + w]) for x in [words(t or "")] for i in range(len(x) - w + 1)}
    di = [(d, grams(t)) for d, t in docs]
    return {(d, i) for i, t in items for d, g in di if g & grams(t)}


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 30)))) for i in range(40)]
    items += [(100, items[3][1]), (101, None), (102, "")]
    docs = []
    for d in range(200):
        body = [rnd.choice(vocab + ["other", "text"]) for _ in range(60)]
        if d % 3 == 0:
            src = items[rnd.randrange(40)][1].split()
            a = rnd.randrange(len(src))
            body[20:20] = [x.upper() + rnd.choice(["", ",", " -"]) for x in src[a : a + rnd.randint(6, 16)]]
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(body)))
    return docs + [(900, None), (901, ""), (902, " . "), (0, docs[0][1])], items


def test_exact_against_brute_force_both_ways(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 8)
    assert len(want) > 20
    for bound, filter_bytes in ((1 << 30, 0), (0, 1 << 24), (0, 0)):  # broadcast, filtered, plain join
        for edits in (0, 1):
            got = [tuple(r) for r in find_leaks(d, i, window=8, max_edits=edits, report=0, broadcast_bytes=bound, filter_bytes=filter_bytes).collect()]
            assert set(got) == want and len(got) == len(want)
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_edited_passages_are_recalled(spark):
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(60)]
    docs = []
    for d, (_, t) in enumerate(items):
        x = t.split()
        x[rnd.randrange(12)] = "changed"
        docs.append((d, " ".join([rnd.choice(vocab) for _ in range(20)] + x + [rnd.choice(vocab) for _ in range(20)])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 30, 0):
        got = {tuple(r) for r in find_leaks(d, i, max_edits=1, broadcast_bytes=bound).collect()}
        assert len(got & {(k, k) for k in range(60)}) >= 0.9 * 60
    assert not find_leaks(d, i).collect()


def test_walk_and_distance():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**60, (50, 12), np.int64).astype(np.uint64)
    b = a.copy()
    b[:, 5] = 7
    assert (edit_distance(a, b) == 1).all() and (edit_distance(a, np.roll(a, 1, axis=1)) == 2).all()
    walk = Walk(12, 0)
    assert (walk.keys(a) == walk.keys(a.copy())).all()
    near = (Walk(12, 2).embed(a) != Walk(12, 2).embed(b)).mean()
    far = (Walk(12, 2).embed(a) != Walk(12, 2).embed(a[::-1])).mean()
    assert near < far / 1.5


def test_recall_by_edits():
    """Measured against brute force: planted windows with 1 to 3 edits of any kind."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    for edits in (1, 2, 3):
        items = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(300)]
        index = ItemIndex(items, Walk(12, edits), edits)
        ids, doc = [], []
        for d, (_, t) in enumerate(items):
            x = t.split()
            for _ in range(edits):
                k = rnd.randrange(len(x))
                kind = rnd.random()
                if kind < 0.5:
                    x[k] = rnd.choice(vocab)
                elif kind < 0.75:
                    x.insert(k, rnd.choice(vocab))
                else:
                    del x[k]
            x = [*x, *(rnd.choice(vocab) for _ in range(12))]
            ids += [index.vocabulary.get(w, -1) for w in x]
            doc += [d] * len(x)
        ids, doc = np.array(ids, np.int32), np.array(doc)
        got = index.search(ids, doc)
        want = set()
        for d in range(300):
            mine = ids[doc == d]
            for s in range(len(mine) - 11):
                if edit_distance(mine[None, s : s + 12], index.rows[d : d + 1])[0] <= edits:
                    want.add((d, d))
        assert len(got & want) >= 0.95 * len(want) and len(want) > 100, (edits, len(got & want), len(want))


def test_candidates_are_held_in_steps():
    items = [(i, "a b c d e f g h i j k l") for i in range(50)] + [(99, "x " * 12)]
    index = ItemIndex(items, Walk(12, 1), 0)
    assert len(index.rows) == 2
    ids = np.array([index.vocabulary[w] for w in "a b c d e f g h i j k l".split()] * 3, np.int32)
    want = {(d, i) for d in range(3) for i in range(50)}
    assert index.search(ids, np.repeat(np.arange(3), 12), step=2) == want


def test_filter_holds_every_key(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key")
    bloom = _bloom(keys, 1 << 24)
    mine = np.array([r.key for r in keys.collect()], np.int64)
    assert _held(bloom, mine).all() and _held(bloom, mine ^ 12345).mean() < 0.02
    assert _bloom(keys, 10) is None
