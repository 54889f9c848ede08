import json
import random

import pyarrow as pa
import pytest

from tagweave.operators.packed import explode_packed, split_batch, split_scalar

CASES = [
    (None, []),
    ("", []),
    (" ; , ", []),
    ("Toru", ["Toru"]),
    ("A, B ; C|D、E\nF / G", list("ABCDEFG")),
    ('"the ""Old"" Mill", x', ['the "Old" Mill', "x"]),
    ('"A, B";"C | D"', ["A, B", "C | D"]),
    (r"A\, The;B", ["A, The", "B"]),
    ("'t Veld,'s Berg", ["'t Veld", "'s Berg"]),
    ("'A, Old' | 't B", ["A, Old", "'t B"]),
    ('{A,"B, C"}', ["A", "B, C"]),
    ('["a\\u00e9", "b \\"c\\"", ""]', ["aé", 'b "c"']),
    ('Gauge 12" pipe, B', ['Gauge 12" pipe', "B"]),
    (' / "A" /   / B / ', ["A", "B"]),
    ("A, A, A", ["A", "A", "A"]),
    ('"', ['"']),
    ("ã\u0083 , b", ["ã\u0083 ", "b"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert split_scalar(text) == want
    assert split_batch(pa.array([text], pa.string())).to_pylist() == [want]


def test_all_cases_in_one_batch():
    assert split_batch(pa.array([c for c, _ in CASES], pa.string())).to_pylist() == [w for _, w in CASES]
    sliced = pa.array(["zz, y", *[c for c, _ in CASES]], pa.string()).slice(1)
    assert split_batch(sliced).to_pylist() == [w for _, w in CASES]
    assert split_batch(pa.array([], pa.string())).to_pylist() == []


def test_random_packing_round_trips():
    """Names packed by random styles come out as they went in."""
    rnd = random.Random(7)
    names = ["Bern", "Old Town", "L'Orme", "'t Veld", "D, The", "a | b", "x / y", 'the "Old" X', "東京", "ñandú", "N;M", "(Q)"]
    fields, want = [], []
    for _ in range(3000):
        chosen = [rnd.choice(names) for _ in range(rnd.randint(1, 6))]
        style = rnd.random()
        if style < 0.1:
            fields.append(json.dumps(chosen, ensure_ascii=rnd.random() < 0.5))
        else:
            sep = rnd.choice([",", ";", "|", " | ", "、", "\n", " / ", ", ", " ;"])
            slots = []
            for c in chosen:
                packs = any(s in c for s in ",;|") or " / " in c
                if '"' in c or packs or rnd.random() < 0.3:
                    if packs and '"' not in c and rnd.random() < 0.3 and "'" not in c:
                        slots.append(f"'{c}'")
                    else:
                        slots.append('"' + c.replace('"', '""') + '"')
                else:
                    slots.append(c)
                if rnd.random() < 0.1:
                    slots.append(" ")
            fields.append(" " * rnd.randint(0, 1) + sep.join(slots))
        want.append(chosen)
    assert split_batch(pa.array(fields)).to_pylist() == want
    assert [split_scalar(f) for f in fields] == want


def test_explode_with_clashing_columns_nulls_and_long_text(spark):
    long = ",".join(f"n{i}" for i in range(20000))
    df = spark.createDataFrame([(1, "a;b", 9), (1, "a;b", 9), (None, "c", 1), (2, None, 1), (3, long, 1)], "row_id long, packed string, pos int")
    rows = explode_packed(df, "packed", "row_id", "pos", "v").collect()
    assert [r for r in rows if r.row_id == 1] == [(1, 1, "a"), (1, 2, "b"), (1, 1, "a"), (1, 2, "b")]
    assert sum(r.row_id == 3 for r in rows) == 20000 and (None, 1, "c") in rows
    assert explode_packed(df.limit(0), "packed", "row_id").count() == 0
