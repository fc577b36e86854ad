"""Delimited text: records over lines and splits, escapes, malformed records, against a plain parser of whole files."""

import csv
import io
import random

import pytest

from sparkprep.sources import delimited, readers


def plain(text, sep=",", escape='"', width=None):
    """(header, sound rows padded with None, malformed records) by the standard parser; a quote that never ends makes a malformed record of all that follows."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep, doublequote=escape == '"', escapechar=None if escape == '"' else escape)
    rows = [r for r in reader if r]
    head, rows = rows[0], rows[1:]
    width = len(head)
    sound = [tuple((x.replace("\r\n", "\n") or None) if x else None for x in r) + (None,) * (width - len(r)) for r in rows if len(r) <= width]
    return head, sound, sum(len(r) > width for r in rows)


def messy(seed, n, sep=",", escape='"'):
    r = random.Random(seed)

    def quoted(x):
        return '"' + x.replace('"', escape + '"') + '"'

    out = [sep.join(["id", quoted("a\nb"), "note", "last"])]
    for i in range(n):
        note = r.choice(["plain", quoted("line one\nline two"), quoted(f'say "hi"{sep} there'), quoted("\n\n"), quoted(""), "", '5" pipe', quoted("x" * r.randint(0, 300) + "\n" + "y" * r.randint(0, 300))])
        fields = [str(i), quoted(f"r{i}"), note, r.choice(["z", quoted("end\nof it"), "ünï"])]
        kind = r.random()
        out.append(sep.join(fields + ["extra"] if kind < 0.05 else fields[:2] if kind < 0.1 else fields))
        if kind > 0.97:
            out.append("")
    return "\n".join(out) + "\n"


def found(spark, path, **options):
    df, bad = readers.read_delimited(spark, str(path), **options)
    return df.columns, sorted((tuple(None if x is None else str(x) for x in r) for r in df.collect()), key=repr), bad


@pytest.mark.parametrize(("sep", "escape", "split"), [(",", '"', None), (";", "\\", None), ("|", '"', 700), ("\t", "\\", 333)])
def test_records_over_lines_and_splits(spark, tmp_path, sep, escape, split):
    text = messy(5, 200, sep, escape)
    (tmp_path / "a.csv").write_text(text)
    head, rows, bad = plain(text, sep, escape)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        names, got, lost = found(spark, tmp_path / "a.csv", escapechar=None if escape == '"' else escape)
        if split:
            assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert names == readers.normalise_headers(head)
    assert got == sorted(rows, key=repr) and lost == bad > 0


def test_a_record_longer_than_several_splits_and_one_that_never_ends(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,two\n')
    (tmp_path / "b.csv").write_text('k,v\n3,"x\ny"\n4,"never\nends\n5,five\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        names, got, bad = found(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (names, got, bad) == (["k", "v"], sorted([("1", long), ("2", "two"), ("3", "x\ny")], key=repr), 1)


def test_one_line_too_long_and_one_too_short(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4,5,6,7\n8,9\n10,,12\n")
    names, got, bad = found(spark, tmp_path / "a.csv")
    assert (names, got, bad) == (["a", "b", "c"], sorted([("1", "2", "3"), ("8", "9", None), ("10", None, "12")], key=repr), 1)
    assert dict(readers.read_delimited(spark, str(tmp_path / "a.csv"))[0].dtypes) == {"a": "int", "b": "int", "c": "int"}  # the malformed record has no say


def test_latin_text_over_lines_and_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('k,v\n1,"caf\xe9\nx"\n'.encode("latin-1"))
    assert found(spark, tmp_path / "a.csv")[1] == [("1", "café\nx")]
    (tmp_path / "b.csv").write_bytes('﻿"k",v\n1,"x\ny"\n'.encode())
    assert found(spark, tmp_path / "b.csv")[:2] == (["k", "v"], [("1", "x\ny")])


def test_no_header_comments_and_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# said\n1,"x\ny"\n# more\n2,z\n')
    assert found(spark, tmp_path / "a.csv", header=False, comment="#")[:2] == (["_c0", "_c1"], [("1", "x\ny"), ("2", "z")])
    (tmp_path / "b.csv").write_text("\n\n")
    assert found(spark, tmp_path / "b.csv") == ([], [], 0)


def test_the_function_of_a_line():
    inside = lambda line, begins, escape='"': delimited.ends_inside(line, begins, ",", '"', escape)
    assert inside('a,"b', False) and not inside('a,5" b', False) and not inside('"a""b",c', False) and inside('"a""', False)
    assert inside("still", True) and not inside('done",x', True) and inside('done","again', True) and inside('a ""', True)
    assert inside('a\\"', True, "\\") and not inside('a\\\\"', True, "\\")


@pytest.mark.parametrize("empty", ["", "\n \n"])
def test_the_first_file_may_be_empty(spark, tmp_path, empty):
    (tmp_path / "a.csv").mkdir()
    (tmp_path / "a.csv" / "part-0 a.txt").write_text(empty)
    (tmp_path / "a.csv" / "part-1 b.txt").write_text('1;"x\ny";2.5\n2;z;3.5\n')
    rows, bad = readers.read_delimited(spark, str(tmp_path / "a.csv"), header=False)
    assert sorted(map(tuple, rows.collect())) == [(1, "x\ny", 2.5), (2, "z", 3.5)] and bad == 0
    (tmp_path / "b.json").mkdir()
    (tmp_path / "b.json" / "part-0 a.txt").write_text(empty)
    (tmp_path / "b.json" / "part-1 b.txt").write_text('{"a": 1}\n{"a": 2}\n')
    rows, bad = readers.read_json(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, rows.collect())) == [(1,), (2,)] and bad == 0
