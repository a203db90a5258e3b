"""Inputs that are easy to get wrong: dates, late values and lines, headers, failing checks."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tablepact import catalogue
from tablepact.catalogue.sources import TABLES
from tablepact.contract import TableContract
from tablepact.functions import coerce as C
from tablepact.functions import predicates as P
from tablepact.functions.types import SPARK_TYPE
from tablepact.operators import attempts, checks, clean, framecheck, profile, rowcheck
from tablepact.operators import consistency as H
from tablepact.sources import catalog, files, strict
from tablepact.streaming import logs as S

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_what_counts_as_a_date_is_kept_by_cleaning(spark):
    rng = random.Random(4)
    day = [datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(700)) for _ in range(40)]
    formats = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%d-%m-%Y", "%b %d, %Y", "%d %B %Y",
               "%Y-%m-%dT10:00:00", "%Y-%m-%d 23:59", "%Y-%m"]
    texts = [d.strftime(f) for d in day for f in formats] + ["", "x", "2024-13-01", "32/01/2024", "99999999"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    contract = TableContract.from_dict("t", {"columns": [{"name": "d", "type": "date"}]})
    both = df.select("d", P.is_date_text(F.col("d")).alias("is_date")).collect()
    cleaned = [r.d for r in clean.clean(df, contract).collect()]
    assert [r.is_date for r in both] == [c is not None for c in cleaned]
    assert all(c is not None for c in cleaned[:len(day) * len(formats)])
    assert [c for t, c in zip(texts, cleaned, strict=True) if t == day[0].strftime("%b %d, %Y")][0] == day[0]


def test_order_of_day_and_month(spark):
    df = spark.createDataFrame([("03/04/2024",), ("25/04/2024",), ("04/25/2024",)], "d string")
    def parsed(**kw):
        contract = TableContract.from_dict("t", {"columns": [{"name": "d", "type": "date", **kw}]})
        return [str(r.d) for r in clean.clean(df, contract).collect()]
    assert parsed() == ["2024-03-04", "2024-04-25", "2024-04-25"]
    assert parsed(day_first=True) == ["2024-04-03", "2024-04-25", "2024-04-25"]
    assert df.select(C.to_iso_date(F.col("d"), formats=("yyyy-MM-dd",)).alias("d")).where("d is not null").count() == 0


def test_order_of_a_whole_column(spark):
    df = spark.createDataFrame([("02/03/2024", "02/03/2024", "1/2/24"), ("25/03/2024", "03/25/2024", "3/4/69"), (None, "13.01.2024", "x")],
                               "a string, b string, c string")
    contract = TableContract.from_dict("t", {"columns": [{"name": n, "type": "date"} for n in "abc"]})
    orders = {r["column"]: (r["order"], r["undecidable_values"]) for r in profile.date_orders(df, list("abc")).collect()}
    assert orders == {"a": ("day_first", 1), "b": ("mixed", 1), "c": ("unknown", 2)}
    rows = clean.clean(df, profile.with_date_orders(df, contract)).select("a", "b", "c").collect()
    assert [[str(v) for v in r] for r in rows] == [["2024-03-02", "2024-02-03", "2024-01-02"], ["2024-03-25", "2024-03-25", "1969-03-04"],
                                                   ["None", "2024-01-13", "None"]]


def test_dates_with_weekdays_and_times(spark):
    day = "2024-01-15"
    texts = ["15-Jan-2024", "15-January-2024", "2024-01-15 10:00 PM", "01/15/24", "Mon, 15 Jan 2024", "Monday 01/15/2024 3:04:05 am",
             "Jan 15, 2024 23:59", "2024/01/15T08:00", "Mon, 15 Jan 2024 10:00 AM"]
    wrong = ["15-Foo-2024", "2024-01-15 25:00", "Moonday, 15 Jan 2024", "10:00 PM", "01/15/24 x", "2024-13-45 10:00 PM", "Mon,"]
    df = spark.createDataFrame([(t,) for t in texts + wrong], "d string")
    found = [r[0] for r in df.select(P.parse_date(F.col("d"))).collect()]
    assert [str(d) for d in found[:len(texts)]] == [day] * len(texts) and found[len(texts):] == [None] * len(wrong)


def test_late_values_are_found(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") >= 200, F.col("id").cast("string")).alias("v"))
    got = {r.column: r for r in profile.infer_schema(df, order_by=["id"]).collect()}
    assert got["v"].type == "integer" and got["v"].sample_values == ["200", "201", "202", "203", "204"]
    head = {r.column: r for r in profile.infer_schema(df, 100, ["id"]).collect()}
    assert head["v"].type == "unknown" and head["v"].sample_values == [] and head["v"].null_count == 200


def test_strict_load_takes_plain_text_only(spark):
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "k", "type": "integer", "primary_key": True}, {"name": "x", "type": "float"}, {"name": "d", "type": "date"}]})
    rows = [("1", "5d", "2024-01-01"), ("2", "5.5", "2024"), ("x3", "1", ""), ("4", " 1e3 ", "2024-1-5"), ("", "1", "")]
    raw = spark.createDataFrame(rows, "k string, x string, d string")
    good, bad = strict.split_rejects(raw, contract)
    assert [r.k for r in good.collect()] == ["4"]
    assert sorted(r.k for r in bad.collect()) == ["", "1", "2", "x3"]
    with pytest.raises(Exception, match="PRIMARY KEY"):
        strict.strict_load(spark.createDataFrame([("1", "", ""), ("01", "", "")], raw.schema), contract).collect()


def test_headers_bind_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    rows = files.stage_csv(spark, str(tmp_path), ["a", "b"])
    assert rows.columns == ["a", "b"] and {tuple(r) for r in rows.collect()} == {("1", "2")}
    assert files.read_rows(spark, str(tmp_path / "b.csv"), ["a", "b"]).first().a == "1"
    for wrong in (["a"], ["a", "b", "c"], ["a", "c"]):
        with pytest.raises(ValueError):
            files.stage_csv(spark, str(tmp_path), wrong)


def test_log_tail_goes_back_as_far_as_needed(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.log").write_text("".join(f"{i}-{j}\n" for j in range(3)))
    for n in (1, 3, 4, 15, 40):
        lines = [f"{i}-{j}" for i in range(5) for j in range(3)]
        assert [r.line for r in files.read_log(spark, str(tmp_path), n).collect()] == lines[-n:]


def test_late_lines_count(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    import os
    for i, hour in enumerate((20, 12, 3)):  # newest first
        (folder / f"{i}.log").write_text(f"2024-01-01 {hour:02d}:00:00 - ERROR - x\n")
        os.utime(folder / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    windows = S.level_windows(S.stream_lines(spark, str(folder), 1))
    S.write_windows(windows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert S.latest_windows(spark, str(tmp_path / "out")).agg(F.sum("line_count")).first()[0] == 3
    bounded = S.write_windows(S.level_windows(S.stream_lines(spark, str(folder), 1), delay="1 hour"),
                              str(tmp_path / "out2"), str(tmp_path / "state2"))
    bounded.awaitTermination()
    counted = S.latest_windows(spark, str(tmp_path / "out2")).agg(F.sum("line_count")).first()[0]
    assert counted + S.late_lines(bounded) == 3 and counted < 3


def test_a_failing_check_leaves_the_others(spark):
    df = spark.createDataFrame([(1, "x"), (2, "7")], "id int, amt string")
    got = {r.check_id: r.status for r in checks.run_checks(df, [
        checks.Check("a", "", condition="id < 0"), checks.Check("b", "", condition="cast(amt as int) < 0"),
        checks.Check("c", "", condition="1 / (id - 1) > 5"), checks.Check("d", "", condition="id = 1")]).collect()}
    assert got == {"a": "PASS", "b": "ERROR", "c": "ERROR", "d": "FAIL"}


def test_every_type_name_is_valid_after_cleaning(spark):
    names = list(SPARK_TYPE)
    default = {"integer": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "string": "s", "text": "s",
               "date": "2000-01-01", "datetime": "2000-01-01 00:00:00", "boolean": False, "bool": False, "json": "{}"}
    contract = TableContract.from_dict("t", {"columns": [
        {"name": f"c_{n}", "type": n, "nullable": False, "default": default[n]} for n in names]})
    raw = spark.createDataFrame([("7",) * len(names), (None,) * len(names)], ", ".join(f"c_{n} string" for n in names))
    assert framecheck.frame_issues(clean.clean(raw, contract), contract).count() == 0
    bounds = TableContract.from_dict("t", {"columns": [
        {"name": "a", "type": "bigint", "max": 5}, {"name": "b", "type": "double", "min": 3.5},
        {"name": "c", "type": "text", "max_length": 2}]})
    df = spark.createDataFrame([(9, 1.0, "long")], "a bigint, b double, c string")
    assert sorted(r.issue for r in framecheck.frame_issues(df, bounds).collect()) == ["above_max", "below_min", "too_long"]
    text = df.select(*[F.col(c).cast("string") for c in df.columns], F.lit(1).alias("row"))
    assert sorted(r.column for r in rowcheck.check_rows(text, bounds, "row").collect()) == ["a", "b"]


def test_unknown_attempt_types_fail(spark):
    log = spark.createDataFrame([(1, "p", "rollback", None)], "seq long, pipeline string, type string, error string")
    with pytest.raises(Exception, match="Unknown attempt type"):
        attempts.attempt_history(log).collect()


def test_adhoc_errors_and_limits(spark):
    assert catalog.run_query(spark, "SELECT 1 / (id - 1) AS x FROM range(3)").execute()[1]
    assert catalog.run_query(spark, "SELECT reflect('java.lang.Math', 'abs', -1)").error
    assert catalog.run_query(spark, "SELECT id FROM range(3)", 2).truncated
    assert not catalog.run_query(spark, "SELECT id FROM range(3)", 3).truncated


def test_damaged_table_is_reported(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    spark.range(3).createOrReplaceTempView("sound_table")
    spark.read.schema("id long").parquet(str(tmp_path)).createOrReplaceTempView("damaged_table")
    got = {r.table: (r.row_count, r.status) for r in catalog.table_status(spark, ["sound_table", "damaged_table"]).collect()}
    assert got == {"sound_table": (3, "ok"), "damaged_table": (None, "error")}


def test_wide_keys_do_not_move_unique_texts(spark):
    df = spark.createDataFrame([("a" * 50,), ("b" * 50,), ("a" * 50,)], "k string")
    assert [r.row_count for r in H.duplicate_keys(df, ["k"], wide=True).collect()] == [2]
    plan = H.duplicate_keys(df, ["k"], wide=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def folders_of(spark, tmp_path):
    """The smallest tables; orders as a folder of three files, customer as a folder that holds no rows."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF_DIR}/{t}.parquet")
    for t in ("orders", "customer"):
        (tmp_path / f"{t}.parquet").unlink()
        rows = spark.read.parquet(f"{SF_DIR}/{t}.parquet")
        (rows.repartition(3) if t == "orders" else rows.limit(0)).write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)


def test_sources_that_are_folders_are_valid(spark, tmp_path):
    path = folders_of(spark, tmp_path)
    valid = {r["name"]: r["is_valid"] for r in catalogue.queries()["valid_source_files"](spark, path).collect()}
    assert valid == {t: t != "customer" for t in TABLES}


def test_flags_of_sources_that_are_folders(spark, tmp_path):
    path = folders_of(spark, tmp_path)
    flags = catalogue.queries()["file_flags"](spark, path).collect()
    assert sorted(r["name"] for r in flags) == sorted(TABLES)
    assert {tuple(r)[1:] for r in flags} == {(True, True, False, True)}


def test_rows_of_sources_that_are_folders(spark, tmp_path):
    path = folders_of(spark, tmp_path)
    read = catalogue.queries()["source_files_read"](spark, path).collect()
    assert sorted(r["name"] for r in read) == sorted(TABLES) and all(r["has_size"] for r in read)
    rows = {r["name"]: r["rows"] for r in read}
    assert rows["customer"] == 0 and rows["orders"] == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
