"""The scan of quote states against a strict CSV reader, over splits of a few bytes."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveframe import read_table
from sieveframe.session import written
from sieveframe.sources.files import probe_files
from sieveframe.sources.records import (PLAIN, chosen_delimiter, cut_records, fold_splits, line_code, placed_splits, raw_lines,
                                        record_width, states)


@pytest.fixture
def tiny_splits(spark):
    """Files are read in pieces of 16 bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "16b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def strict(text, sep=";"):
    """Records as a strict reader cuts them, and whether it takes the text at all."""
    try:
        return list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True))
    except csv.Error:
        return None


def made(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "é", '"', '""', ";", ",", "\n", "\r\n", "\r", " ", '"x"', '"y;\nz"', ';"', '";', '"\n', "\n\n"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_strict_reader(spark, tiny_splits, tmp_path, seed):
    texts = made(seed, 60)
    for k, text in enumerate(texts):
        (tmp_path / f"{k:03d}.csv").write_bytes(text.encode())
    lines = raw_lines(spark, str(tmp_path))
    splits = written(placed_splits(fold_splits(lines, [";"])), "splits")
    bad = {r["path"][-7:-4] for r in splits.groupBy("path").agg({"odd_lines": "sum", "block": "max"}).where("`sum(odd_lines)` > 0").collect()}
    last = {}
    for r in splits.collect():
        if r["block"] >= last.get(r["path"][-7:-4], (-1, 0))[0]:
            last[r["path"][-7:-4]] = (r["block"], r["ends_inside"])
    assert {f"{k:03d}" for k, t in enumerate(texts) if strict(t) is None} == bad | {k for k, (_, open_) in last.items() if open_}
    found = {}
    for r in cut_records(lines, splits, ";").select("*", record_width(F.col("text"), ";").alias("w")).collect():
        found.setdefault(r["path"][-7:-4], []).append(r)
    accepted = 0
    for k, text in enumerate(texts):
        expected = strict(text)
        if expected is None:
            continue
        accepted += 1
        rows = sorted(found[f"{k:03d}"], key=lambda r: r["record"])
        assert [r["record"] for r in rows] == list(range(len(expected))), text
        assert [next(csv.reader(io.StringIO(r["text"], newline=""), delimiter=";"), []) for r in rows] == expected, text
        assert [r["w"] if r["text"] else 0 for r in rows] == [len(e) for e in expected], text
        assert [r["line"] for r in rows] == first_lines(text), text
    assert accepted > 10


def first_lines(text):
    """The number of the physical line at which each record begins."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=";", strict=True)
    ends = [0, *(reader.line_num for _ in reader)]
    return ends[:-1]


def test_states_compose():
    rng = np.random.default_rng(5)
    for _ in range(200):
        codes = rng.choice([0, 1, 2, 3, PLAIN, PLAIN], rng.integers(0, 12)).astype(np.int32)
        for begins in (False, True):
            state, before = begins, []
            for code in codes:
                before.append(state)
                state = bool(code & (2 if state else 1))
            got, end = states(codes, begins)
            assert end == state and (len(codes) == 0 or got.tolist() == before)


def test_codes_of_lines(evaluate):
    lines = ["a;b", 'a;"b', '5" pipe', '"a";"b"', '"a"b', '"', '"a""', ";", 'x"y;"z']
    codes = evaluate(lambda c: line_code(c, ";"), lines)
    assert codes[:3] == [2, 1 | 8, 8] and codes[3:6] == [8, 4 | 8, 1] and codes[6:8] == [1 | 8, 2] and codes[8] & 1


def test_refused_and_taken(spark, put):
    for text in ('k,v\n1,"x\n2,"y\n3,z\n', 'k,v\n1,"x\n2,5" pipe\n', 'k,v\n1,"x\n2,y\n', 'k,v\n1,"x"y\n'):
        with pytest.raises(ValueError):
            read_table(spark, put(text))
        table = read_table(spark, put(text), strict=False)
        assert table.warnings and table.data.count() >= 1
    table = read_table(spark, put('k,v\n1,5" pipe\n2,"x\ny"\n3,z\n'))
    assert not table.warnings
    assert [tuple(r) for r in table.data.select("k", "v").collect()] == [("1", '5" pipe'), ("2", "x\ny"), ("3", "z")]


def test_line_ends_inside_cells_stay(spark, put):
    table = read_table(spark, put('k;v\r\n1;"a\r\nb\n\rc"\r\n\r\n2;d\r\n'), place=True)
    assert [tuple(r) for r in table.data.select("row", "line", "k", "v", "_width").collect()] == [
        (1, 2, "1", "a\r\nb\n\rc", 2), (2, 6, "", "", 0), (3, 7, "2", "d", 2)]


def test_headers_over_several_lines_and_blank_ones(spark, put):
    table = read_table(spark, put('"first\nname";b\n\n1;2\n'))
    assert table.originals == ["first\nname", "b"] and table.names == ["first_name", "b"]
    assert [tuple(r) for r in table.data.collect()] == [("", "", 0), ("1", "2", 2)]
    with pytest.raises(ValueError):
        read_table(spark, put("\na;b\n1;2\n"))


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "cp1252", "utf-8-sig"])
def test_line_breaks_and_blank_lines_in_any_encoding(spark, tiny_splits, put, encoding):
    text = 'id;"nó,te"\n001;"João\n €"\n\n002;x\n'
    path = put(("﻿" if encoding[-3:] in ("-le", "-be") else "") + text, encoding=encoding)
    table = read_table(spark, path, place=True, ordered=True)
    assert [tuple(r) for r in table.data.select("id", "no_te", "record").collect()] == [("001", "João\n €", 1), ("", "", 2), ("002", "x", 3)]


def test_places_in_several_files(spark, tiny_splits, tmp_path):
    for name, rows in (("b", 3), ("a", 40), ("c", 1)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f'{name}{i},"x\n{i}"\n' for i in range(rows)))
    data = read_table(spark, str(tmp_path), "csv", place=True, ordered=True).data.collect()
    assert [r["row"] for r in data] == list(range(1, 45))
    assert [r["k"] for r in data] == [f"{n}{i}" for n, k in (("a", 40), ("b", 3), ("c", 1)) for i in range(k)]
    assert [r["line"] for r in data[40:]] == [2, 4, 6, 2]


@pytest.mark.parametrize("head,mark", [
    ("Valor, R$;Nome\n1;x\n", ";"), ('"a,b,c";d', ";"), ("a,b;c", ","), ("abc", ","), ("a;b|c;", ";"), ("a\tb|c\td", "\t"), ("", ","),
    ("x;y\n1,5;2\n1,5;2\n", ";"), ('a|"b,c,d"\n1|"e,f\n,g"\n', "|"), ("one, two\n\nx;y\n", ","),
    ('id;"no,te"\n', ";")])
def test_delimiters_cut_records_alike(head, mark):
    assert chosen_delimiter(head, False) == mark


def test_probe_names_what_is_open(spark, tmp_path):
    for name, text in (("a", 'x;y\n1;"p\nq"\n'), ("b", 'x;y\n1;"p\n'), ("c", 'x;y\n1;"p"q\n\n'), ("d", 'x;y\n1;5" p\n')):
        (tmp_path / f"{name}.csv").write_text(text)
    found = {r["path"][-5]: (r["open_lines"], r["odd_lines"], r["unclosed"], r["blank_lines"]) for r in probe_files(spark, str(tmp_path)).collect()}
    assert found == {"a": (1, 0, False, 0), "b": (1, 0, True, 0), "c": (0, 1, False, 1), "d": (0, 0, False, 0)}
