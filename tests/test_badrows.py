import csv
import io
import random

from tagweave.operators.badrows import assemble_records, failures, parse_fields, parse_lines, valid

GOOD = "7\tA\tA\t\t1.5\t-2\tP\tPPL\tXA\t\t\t\t\t\t10\t\t3\tEtc\t2020-01-01"


def line(**at):
    f = GOOD.split("\t")
    for k, v in at.items():
        f[int(k[1:])] = v
    return "\t".join(f)


CASES = {
    GOOD: None,
    line(_0="007"): None,
    line(_1='"A\tB"'): None,
    line(_1='A "x"'): None,
    line(_1='""'): None,
    line(_14=""): None,
    line(_14="0"): None,
    line(_0=str(2**63 - 1)): None,
    line(_0="0" * 30 + "5"): None,
    line(_1='"A" '): "quoting",
    line(_18='"open'): "quoting",
    line(_0="0"): "geonameid",
    line(_0=str(2**63)): "geonameid",
    line(_0="٣"): "geonameid",
    line(_0=""): "geonameid",
    line(_0="1 "): "geonameid",
    line(_14="1,000"): "population",
    line(_14="-1"): "population",
    line(_14=str(2**63)): "population",
    line(_0="x", _14="y"): "geonameid",
    "": "columns",
    GOOD + "\t": "columns",
    "a|b": "columns",
    '"a\tb': "quoting",
    line(_1="a\rb"): None,
    line(_1='"a\nb"'): None,
}


def test_reasons_and_typed_rows(spark):
    rows = [(i, s, "x") for i, s in enumerate(CASES)] + [(99, None, "x"), (99, None, "x")]
    parsed = parse_lines(spark.createDataFrame(rows, "raw_id long, raw_line string, reason string"), "raw_line", ["raw_id"]).cache()
    got = {r.raw_id: r.reason for r in failures(parsed, ["raw_id"]).collect()}
    assert [got.get(i) for i in range(len(CASES))] == list(CASES.values())
    assert failures(parsed, ["raw_id"]).where("raw_id = 99").count() == 2
    first = valid(parsed).where("raw_id = 0").first()
    assert (first.geonameid, first.latitude, first.alternatenames, first.dem, first.elevation) == (7, 1.5, None, 3, None)
    assert valid(parsed).where("raw_id = 2").first().main_name == "A\tB"
    assert valid(parsed).where("main_name = 'a\rb'").count() == 1
    assert parse_lines(spark.createDataFrame([], "raw_id long, raw_line string"), "raw_line", ["raw_id"]).count() == 0


def test_fields_against_plain_scan():
    assert parse_fields('"a""b"\tc') == ['a"b', "c"]
    assert parse_fields("x" * 200_000 + "\ty") == ["x" * 200_000, "y"]


def test_assembly():
    assert list(assemble_records(['"a', 'b"\tc', "d"], max_lines=3)) == ['"a\nb"\tc', "d"]
    assert list(assemble_records(['"a', 'b"\tc', "d"])) == ['"a', 'b"\tc', "d"]
    assert list(assemble_records(['"a', "b"], max_lines=2)) == ['"a', "b"]
    assert list(assemble_records(['x\t"a""', "", '""b"\t"c"', 'd"', '"e" f', "g"], max_lines=9)) == ['x\t"a""\n\n""b"\t"c"', 'd"', '"e" f', "g"]
    assert list(assemble_records(['"a', "b", '"c', 'd"'], max_lines=2)) == ['"a', "b", '"c\nd"']


def test_assembly_against_the_reader():
    """Assembled records of well-formed rows are what csv reads from the file."""
    rnd = random.Random(4)
    for _ in range(500):
        rows = [["".join(rnd.choice('ab"\n\t ') for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 6))]
        rows = [r for r in rows if r != [""]]
        text = io.StringIO()
        csv.writer(text, delimiter="\t", lineterminator="\n").writerows(rows)
        physical = text.getvalue().split("\n")[:-1]
        got = list(assemble_records(physical, max_lines=len(physical) + 1))
        assert [parse_fields(x) for x in got] == rows


def test_assembly_takes_linear_time():
    many = ['"open'] + ["x"] * 200_000
    assert len(list(assemble_records(many, max_lines=len(many) + 1))) == len(many)


def test_stand_ins_of_the_text_itself():
    assert parse_fields('"a\nb\ue00a\ue000"\tc\ue00d') == ["a\nb\ue00a\ue000", "c\ue00d"]
