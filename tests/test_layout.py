"""Parts over one global order against a plain layout, for any way in which rows are dealt to tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sieveframe import clean, read_table, write_result_in_order
from sieveframe.sinks import layout
from sieveframe.sinks.parts import LINE_END, header_line


def plain_layout(lines, room):
    """``(first row, last row, first byte, bytes)`` of every part, by one walk over all lines."""
    sizes = [len(line.encode()) + 2 for line in lines]
    largest = max((s for s in sizes if s <= room // 2), default=0)
    parts, key, small, large, offset = [], None, 0, 0, 0
    for row, size in enumerate(sizes):
        if size > room // 2:
            large += 1
            found = (large, 0)
        else:
            found = (large, 1 + small // (room - largest))
            small += size
        if found != key:
            parts.append([row, row, offset, 0])
        key = found
        parts[-1][1] = row
        parts[-1][3] += size
        offset += size
    return [tuple(p) for p in parts]


def found_layout(layout_):
    rows = sorted(layout_.collect(), key=lambda r: r.part)
    assert [r.part for r in rows] == list(range(len(rows)))
    assert all(r.rows == r.last_row - r.first_row + 1 for r in rows)
    return [(r.first_row, r.last_row, r.first_byte, r.bytes) for r in rows]


def files_in_order(path):
    found = sorted(os.path.join(at, name) for at, _, names in os.walk(path) for name in names if name.startswith("part-"))
    return [open(f, "rb").read().decode() for f in found]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(11)
    sizes = [rng.choice([0, 1, 5, 20, 40, 70, 150]) for _ in range(700)]
    return [(i, rng.choice("xé中") * n) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_layout_depends_on_the_lines_alone(spark, lines, tasks, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "FOLDER_BITS", 4)  # several folders, and several parts in a task
    df = spark.createDataFrame(lines, "row int, part string").repartitionByRange(tasks, "row").sortWithinPartitions("row")
    head = header_line(["row", "part"], ",") + LINE_END
    texts = [f"{i},{text}" for i, text in lines]
    written = layout.write_in_order(df, str(tmp_path / "out"), 700)
    assert found_layout(written) == plain_layout(texts, 700 - len(head.encode()))
    contents = files_in_order(tmp_path / "out")
    assert len(contents) > 16 and len(os.listdir(tmp_path / "out")) > 2
    assert all(c.startswith(head) and len(c.encode()) <= 700 for c in contents)
    assert [line for c in contents for line in c[len(head):].split(LINE_END)[:-1]] == texts
    with pytest.raises(Exception, match="already exists"):
        layout.write_in_order(df, str(tmp_path / "out"), 700)


def test_facts_that_are_not_broadcast(spark, lines, monkeypatch):
    monkeypatch.setattr(layout, "SENT_ROWS", 0)
    df = spark.createDataFrame(lines, "a int, b string").repartition(5).orderBy(F.desc("a"))
    placed = layout.place_lines(df, 900, ";")
    texts = [f"{i};{text}" for i, text in reversed(lines)]
    assert found_layout(layout.part_layout(placed)) == plain_layout(texts, 900 - len((header_line("ab", ";") + LINE_END).encode()))
    rows = sorted(placed.collect(), key=lambda r: r.row)
    assert [r.line for r in rows] == texts and [r.row for r in rows] == list(range(len(texts)))
    assert [r.offset for r in rows] == [sum(len(t.encode()) + 2 for t in texts[:k]) for k in range(len(texts))]


def test_empty_table_nulls_and_rows_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(None, "q\"uote"), ("a,b", None), ("", "l\nm")], "task string, line string").coalesce(1)
    assert [r.line for r in layout.place_lines(df).orderBy("row").collect()] == [',"q""uote"', '"a,b",', ',"l\nm"']
    assert layout.write_in_order(df.where("false"), str(tmp_path / "none")).count() == 0
    assert files_in_order(tmp_path / "none") in ([], [""])
    one = spark.createDataFrame([(1, "x" * 80)], "n int, t string")
    with pytest.raises(Exception, match="exceeds the size"):
        layout.place_lines(one, 60)
    with pytest.raises(ValueError, match="header"):
        layout.place_lines(one, 5)
    with pytest.raises(ValueError, match="delimiter"):
        layout.place_lines(one, sep="#")


def test_result_keeps_its_counters_and_order(spark, put, tmp_path):
    rows = [f" {k} ;=x{k}" if k % 3 else ";" for k in range(120)]
    table = read_table(spark, put("Code;Note\n" + "\n".join(rows) + "\n"), "csv")
    counters = write_result_in_order(clean(table, "tidy"), str(tmp_path / "out"), 200)
    assert (counters["rows_read"], counters["empty_rows_found"], counters["rows_exported"], counters["formula_guarded"]) == (120, 40, 80, 80)
    contents = files_in_order(tmp_path / "out")
    assert len(contents) > 4 and all(len(c.encode()) <= 200 and c.startswith("\ufeffcode,note\r\n") for c in contents)
    assert [line for c in contents for line in c.split(LINE_END)[1:-1]] == [f"{k},'=x{k}" for k in range(120) if k % 3]
    with pytest.raises(ValueError, match="only analyses"):
        write_result_in_order(clean(table, "profile"), str(tmp_path / "none"))


def test_small_parts_share_tasks(spark, tmp_path):
    """One file for each part, names in order, but not one task for each."""
    df = spark.range(3000).selectExpr("id", "repeat('y', 60 + cast(id % 5 as int)) as note").orderBy("id")
    parts = layout.write_in_order(df, str(tmp_path / "out"), 700).count()
    files = sorted((tmp_path / "out").rglob("part-*.txt"))
    assert len(files) == parts > 200 and len({f.name.split("-")[1] for f in files}) <= parts // 2
    lines = [line for f in files for line in f.read_text("utf-8-sig").split("\n")[1:-1]]
    assert [line.split(",")[0] for line in lines] == [str(n) for n in range(3000)]
    assert max(f.stat().st_size for f in files) <= 700
