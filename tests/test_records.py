"""Delimited files cut into records by many tasks, against reading them in one go."""

import contextlib
import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from hoardbook.sources.exports import export_rows, header_dictionary, scan_exports
from hoardbook.sources.records import _ends_inside, cells, part_starts, records, scan_lines


@contextlib.contextmanager
def small_parts(spark, size):
    """Files are read in parts of ``size`` bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def plain(text):
    """Records as a reader finds them that goes through the text from start to end."""
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def found(spark, path):
    lines = scan_lines(spark, path)
    rows = records(lines, part_starts(lines)).select("file_path", "record", cells(F.col("text")).alias("cells")).collect()
    files = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], r["record"])):
        files.setdefault(r["file_path"].rpartition("/")[2], []).append(r["cells"])
        assert r["record"] == len(files[r["file_path"].rpartition("/")[2]])
    return files, lines.select("file_path", "part").distinct().count()


def random_text(r, feeds):
    """Records of plain cells, quoted cells with commas, quotes and line breaks, and stray quotes."""
    out = []
    for _ in range(r.randint(1, 60)):
        row = []
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.4:
                row.append("".join(r.choice("abc é") for _ in range(r.randint(0, 6))))
            elif kind < 0.85:
                inner = "".join(r.choice(["a", ",", '""', "x y", r.choice(feeds), r.choice(feeds) * 2]) for _ in range(r.randint(0, 9)))
                row.append(f'"{inner}"')
            elif kind < 0.93:
                row.append('12" wide' if r.random() < 0.5 else 'a "b" c')
            else:
                row.append('"q"tail')
        out.append(",".join(row))
    end = r.choice(feeds)
    return end.join(out) + r.choice(["", end, end * 3])


@pytest.mark.parametrize("size", [40, 400, 1 << 20])
def test_records_like_one_reader(spark, tmp_path, size):
    r = random.Random(size)
    texts = {f"f{k}.csv": random_text(r, [["\n"], ["\r\n"], ["\n", "\r\n"], ["\r"], ["\n", "\r\n", "\r"]][k % 5]) for k in range(15)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with small_parts(spark, size):
        got, parts = found(spark, str(tmp_path))
    assert got == {name: rows for name, text in texts.items() if (rows := plain(text))}
    assert parts > len(texts) if size < 1000 else parts == len(texts)


def test_record_over_many_parts(spark, tmp_path):
    """A cell longer than many parts, with quotes in it; the header spans two lines."""
    long = "\n".join(f'line ""{i}"", of text' for i in range(400))
    text = f'﻿"a\nb",c\n1,"{long}"\n2,x\n\n"3\n",y\n'
    (tmp_path / "one.csv").write_text(text, encoding="utf-8")
    with small_parts(spark, 256):
        got, parts = found(spark, str(tmp_path))
    assert got["one.csv"] == plain(text.lstrip("﻿")) and parts > 20


def test_quote_never_closed_takes_the_rest(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"two\n3,4\n5,6')
    (tmp_path / "good.csv").write_text('a,b\n1,2\n')
    with small_parts(spark, 4):
        got, _ = found(spark, str(tmp_path))
    assert got == {"open.csv": [["a", "b"], ["1", "two\n3,4\n5,6"]], "good.csv": [["a", "b"], ["1", "2"]]}


def test_empty_files(spark, tmp_path):
    for name, text in {"a.csv": "", "b.csv": "\n\r\n\n", "c.csv": "Title\n"}.items():
        (tmp_path / name).write_text(text)
    assert export_rows(scan_exports(spark, str(tmp_path))).collect() == []


def test_only_lines_of_long_records_move_to_each_other(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\n" + "plain\n" * 1000 + '"two\nlines"\n')
    lines = scan_lines(spark, str(tmp_path))
    cut = records(lines, part_starts(lines)).where("text like '%lines%'")
    assert cut.count() == 1 and lines.where("out_before or out_after").count() == 2


def test_cells_up_to_a_width(spark):
    texts = ["a,b,c,d", '"a,1","b ""2""",c,d', "a", "", ',,"",', '"x', 'p"q,"r"s,t']
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = [r[0] for r in frame.select(cells(F.col("t"))).collect()]
    assert whole == [(plain(t) or [[""]])[0] for t in texts]
    two = [r[0][:2] for r in frame.select(cells(F.col("t"), F.lit(2))).collect()]
    assert two == [row[:2] for row in whole]


def machine(line, inside):
    """The state after a line, and its cells, read character by character."""
    state, done, cell = ("quoted" if inside else "start"), [], ""
    for ch in line:
        if state == "quoted":
            state, cell = ("closed", cell) if ch == '"' else (state, cell + ch)
        elif ch == ",":
            state, cell = "start", done.append(cell) or ""
        elif ch == '"' and state in ("start", "closed"):
            state, cell = "quoted", cell + ('"' if state == "closed" else "")
        else:
            state, cell = "plain", cell + ch
    return state == "quoted", [*done, cell]


def test_lines_like_a_reader_of_characters(spark):
    r = random.Random(5)
    texts = ["".join(r.choice('"",a \x85\u2028') for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["," * 30_000 + '"', '"a",' * 20_000 + '"x', '""' * 20_000 + '"']
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", _ends_inside(F.col("t"), False), _ends_inside(F.col("t"), True), cells(F.col("t"))).collect()
    assert all((b, c, d) == (machine(t, False)[0], machine(t, True)[0], machine(t, False)[1]) for t, b, c, d in got)


def test_lines_are_not_read_by_interpreted_loops(spark):
    frame = spark.createDataFrame([("a",)], "t string").select(_ends_inside(F.col("t"), True), cells(F.col("t")))
    assert "aggregate" not in frame._jdf.queryExecution().analyzed().toString()


def test_only_lines_that_may_be_of_longer_records_move_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\n" + 'plain,""\n' * 100 + '"two\nlines"\n')
    lines = scan_lines(spark, str(tmp_path))
    plan = records(lines, part_starts(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("out_before#") > 2 and " OR ((part#" in plan


def test_files_in_any_folders(spark, tmp_path):
    for folder in ("a=1/b=x", "a=2/b=y", "other"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "one.csv").write_text("Title\nx\n")
    rows = export_rows(scan_exports(spark, str(tmp_path), any_folder=True)).collect()
    assert sorted(row["name"] for row in rows) == ["x"] * 3


DIALECTS = {
    "a.csv": "Product Name,Add to Quantity,Paid\nOne,2,3.5\n",
    "b.csv": "Total Quantity,Title\n4,Two\n",
    "c.csv": "Title,Title,Cost Paid\nold,Three,\n",
    "d.csv": "Something,Else\n1,2\n",
    "e.csv": "Product Name,Add to Quantity,Paid\nFour,5,6\n",
}


def test_one_entry_for_each_header(spark, tmp_path):
    for name, text in DIALECTS.items():
        (tmp_path / name).write_text(text)
    rows = export_rows(scan_exports(spark, str(tmp_path))).collect()
    got = {r["batch_id"].rpartition("/")[2]: (r["name"], r["quantity"], r["paid"]) for r in rows}
    assert got == {"a.csv": ("One", "2", "3.5"), "b.csv": ("Two", "4", ""), "c.csv": ("Three", "", ""),
                   "d.csv": ("", "", ""), "e.csv": ("Four", "5", "6")}
    headers = spark.createDataFrame([(plain(t)[0],) for t in DIALECTS.values()], "header array<string>")
    assert header_dictionary(headers).count() == 4


def test_width_follows_headers_not_data(spark, tmp_path):
    """One cell of 100,000 commas, quoted or not, makes neither plan nor rows wide."""
    (tmp_path / "wide.csv").write_text(f'Product Name,Paid\n"{"," * 100_000}",2\nCard,3{"," * 100_000}\n')
    start = time.time()
    scanned = scan_exports(spark, str(tmp_path))
    rows = {r["row_pos"]: r for r in export_rows(scanned).collect()}
    assert rows[1]["name"] == "," * 100_000 and (rows[1]["paid"], rows[2]["paid"]) == ("2", "3")
    assert time.time() - start < 15
    assert max(len(r["cells"]) for r in scanned.collect()) == 3


def test_parts_are_read_by_many_tasks(spark, tmp_path):
    """One file over many tasks, equal to reading it whole."""
    r = random.Random(3)
    body = [f'"card {i}{chr(10) * (i % 3)}, ""x""",{i},{r.random():.3f}' for i in range(20_000)]
    (tmp_path / "big.csv").write_text("Product Name,Add to Quantity,Paid\n" + "\n".join(body) + "\n")
    with small_parts(spark, 16 << 10):
        scanned = scan_exports(spark, str(tmp_path))
        split = sorted(map(tuple, export_rows(scanned).select("row_pos", "name", "quantity", "paid").collect()))
    whole = sorted(map(tuple, export_rows(scan_exports(spark, str(tmp_path))).select("row_pos", "name", "quantity", "paid").collect()))
    want = plain((tmp_path / "big.csv").read_text())[1:]
    assert split == whole == [(i + 1, n.strip(), q, p) for i, (n, q, p) in enumerate(want)]
