"""Delimited files with line breaks inside quotes, cut into many blocks."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablepact.sources import delimited, files

FIELDS = st.text(st.sampled_from(list('ab",\n\r ')), max_size=8)


def ends(text):
    """Whether the reader is inside quotes behind the text, character by character."""
    state = "start"
    for c in text:
        if state == "start":
            state = "in" if c == '"' else "start" if c == "," else "plain"
        elif state == "plain":
            state = "start" if c == "," else "plain"
        elif state == "in":
            state = "maybe" if c == '"' else "in"
        else:  # behind a quote inside quotes
            state = "in" if c == '"' else "start" if c == "," else "plain"
    return state == "in"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list('ab",')), max_size=14))
def test_lines_as_functions(line):
    assert delimited.ends_inside(line, False) == ends(line)
    assert delimited.ends_inside(line, True) == ends('"x' + line)


def test_expression_agrees_on_well_formed_lines(spark):
    lines = ["", "a,b", '"a,b', '"a",b', 'a,"b', 'a,"b""', 'a,"b"""', 'a"b,c', '"x,y","z', ' "a', '"""', '""', 'a,""']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    found = df.select("line", delimited._opens(F.col("line"), ",").alias("opens")).collect()
    assert {r["line"]: r["opens"] for r in found} == {x: delimited.ends_inside(x, False) for x in lines}


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    yield
    spark.conf.set(key, before)


def odd_files(folder):
    rows = [["1", "two\nlines", 'say "x"'], ["2", "a\r\nb", ""], ["3", '"q"\n\n"r"', "plain"], ["", "x,y\n", ' "lead'],
            ["5", 'st"ray', "é☃"], ["6", "a\n" * 50, "z"]] * 20
    giant = [["7", "middle of several blocks\n" * 400, "end"]]
    with open(folder / "a.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerows([["k", "t", "u"], *rows, *giant, *rows])
        f.write('8,un"quoted" here,st"ray\n\n')
    with open(folder / "b.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerows([["u", "k", "t"], *[[u, k, t] for k, t, u in [*rows, *giant]]])
    (folder / "c.csv").touch()
    want = []
    for name in ("a.csv", "b.csv"):
        with open(folder / name, newline="") as f:
            want += [(r["k"], r["t"], r["u"]) for r in csv.DictReader(f)]
    return sorted(want)


def test_rows_across_blocks(spark, tmp_path, small_blocks):
    want = odd_files(tmp_path)
    assert len(want) > 360
    rows = files.stage_csv(spark, str(tmp_path), ["k", "t", "u"])
    assert sorted((r["k"] or "", r["t"] or "", r["u"] or "") for r in rows.collect()) == want


def test_headers_with_line_breaks(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([["one\nname", "b"], ["1", "2"]])
    rows = files.stage_csv(spark, str(tmp_path))
    assert rows.columns == ["one\nname", "b"] and [tuple(r) for r in rows.collect()] == [("1", "2")]


def test_one_pass_gives_the_headers(spark, tmp_path):
    for i in range(6):
        text = "a,b\n1,2\n" if i % 2 else "b,a\n2,1\n"
        (tmp_path / f"{i}.csv").write_text(("﻿" if i == 3 else "") + text)
    (tmp_path / "empty.csv").touch()
    found = delimited.survey(spark, str(tmp_path))
    assert found.headers == [("b", "a"), ("a", "b")] and not found.broken
    assert {h: len(f) for h, f in found.files.items()} == {("b", "a"): 3, ("a", "b"): 3}
    assert [tuple(r) for r in files.stage_csv(spark, str(tmp_path), ["a", "b"]).collect()] == [("1", "2")] * 6


def test_record_parser_keeps_breaks():
    out = io.StringIO(newline="")
    csv.writer(out).writerow(["a\r\nb", "c\nd", 'q"'])
    assert delimited.parse_record(out.getvalue()) == ("a\r\nb", "c\nd", 'q"')


def test_folder_of_empty_files_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").touch()
    with pytest.raises(ValueError, match="empty"):
        files.validate_sources(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("a\n1\n")
    assert files.validate_sources(spark, str(tmp_path))["size_bytes"] == 4


def test_small_blocks_share_tasks(spark, tmp_path, monkeypatch):
    """Many small blocks are read by as many tasks as there are cores; rows across them stay whole."""
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out).writerows([("a", "b"), *((str(i), f"x\ny,{i}" * 5) for i in range(3000))])
    tasks, real = {}, delimited.written
    monkeypatch.setattr(delimited, "written", lambda df, label: tasks.update({label: df.rdd.getNumPartitions()}) or real(df, label))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        rows = {tuple(r) for r in files.stage_csv(spark, str(tmp_path), ["b", "a"]).collect()}
    finally:
        spark.conf.set(key, before)
    assert rows == {(f"x\ny,{i}" * 5, str(i)) for i in range(3000)}
    assert tasks["blocks"] <= 8 and tasks["pieces"] <= 8
