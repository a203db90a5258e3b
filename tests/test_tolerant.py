"""Conditions that mark what they cannot decide, against the failing originals row by row."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.operators import checks as K
from tablepact.operators.tolerant import Tolerant, Unforeseen, tolerant
from tablepact.plans import flows

ROWS = [("1", "2020-01-01", 5, [1, 2]), ("x", "bad", 0, [3]), (None, None, None, None),
        ("3000000000", "2022-02-30", 2147483647, []), ("7", "2022-02-01", -4, [])]
CONDITIONS = [
    "cast(a as int) > 3 and d < DATE '2021-01-01'", "d < DATE '2021-01-01' and cast(a as int) > 3", "a in (1, 2)", "a not in (1, 2)",
    "n + 1 > 5 or 10 / n > 2", "10 / n > 2", "to_date(d) > DATE '2020-06-01'", "case when a rlike '^[0-9]+$' then a > 3 end",
    "case when n > 0 then a > 3 when n = 0 then false else d > DATE '2020-01-01' end", "n between a and 7", "try_cast(a as int) > 1",
    "coalesce(a, n) > 3", "coalesce(n, a) > 3", "a is null or a > 4", "a < 5", "n % 0 = 1", "not (a > 3)", "if(a is null, true, a > 5)",
    "a <=> 7", "length(a) > 3", "upper(a) = 'X'", "a like '%\\\\%'", "(a + n) * 2 > 7", "cast(cast(a as int) as string) = '7'",
    "cast(n as tinyint) > 1", "cast(a as int) is null", "d = '2020-01-01' or d = DATE '2022-02-01'"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "a string, d string, n int, l array<int>")


def test_same_as_the_failing_form_row_by_row(spark, table):
    found = tolerant(table, *CONDITIONS)
    assert all(isinstance(t, Tolerant) for t in found)
    columns = [c for i, t in enumerate(found) for c in (
        t.value.alias(f"v{i}"), (F.lit(False) if t.fails is None else F.coalesce(t.fails, F.lit(False))).alias(f"f{i}"))]
    got = table.select(*columns).collect()
    for k, row in enumerate(ROWS):
        one = spark.createDataFrame([row], table.schema)
        for i, condition in enumerate(CONDITIONS):
            try:
                want = one.selectExpr(f"({condition}) AS v").first()["v"]
            except Exception:
                assert got[k][f"f{i}"], (condition, row)
            else:
                assert not got[k][f"f{i}"] and got[k][f"v{i}"] == want, (condition, row)


def test_what_has_no_such_form(spark, table):
    user = F.udf(lambda x: True, T.BooleanType())
    spark.udf.register("always", user)
    for condition in ("l[2] = 1", "raise_error('x') is null", "always(a)", "n > (select 1)"):
        assert isinstance(tolerant(table, condition)[0], Unforeseen), condition


def test_each_error_is_its_own(spark, table):
    checks = [K.Check("rows", "", expected="> 0"), K.Check("text", "", condition="a > 3"), K.Check("list", "", condition="l[0] > 7"),
              K.Check("fine", "", condition="n < 0", expected="1"), K.Check("share", "", condition="n < 0", expected="< 1.5"),
              K.Check("raises", "", condition="raise_error('no')"), K.Check("unknown", "", condition="nope(a)")]
    found = {r["check_id"]: r for r in K.run_checks(table, checks).collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "rows": "PASS", "text": "ERROR", "list": "ERROR", "fine": "PASS", "share": "PASS", "raises": "ERROR", "unknown": "ERROR"}
    assert found["text"]["error"] == "1 rows cannot be decided" and found["text"]["actual"] is None


def test_nothing_is_run_beforehand(spark, table, monkeypatch):
    def none_tried(df, checks):
        assert not checks
        return {}
    monkeypatch.setattr(K, "failing_checks", none_tried)
    assert K.run_checks(table, [K.Check(str(i), "", condition=c) for i, c in enumerate(CONDITIONS)]).count() == len(CONDITIONS)


def test_a_broken_job_is_no_failed_check(table, monkeypatch):
    def lost(*_):
        raise RuntimeError("Job aborted due to stage failure: ExecutorLostFailure")
    monkeypatch.setattr(type(table), "agg", lost)
    with pytest.raises(RuntimeError, match="ExecutorLost"):
        K.failing_checks(table, [K.Check("x", "", condition="l[2] = 1")])


def test_write_counts_what_it_cannot_decide(spark, tmp_path, monkeypatch):
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "k", "type": "integer", "nullable": False}, {"name": "code", "type": "string", "enum": [1, 2]}]})
    raw = spark.createDataFrame([("1", "1"), ("2", "x"), ("3", "2")], "k string, code string")
    results, rows = flows.clean_check_and_write(raw, contract, str(tmp_path / "out"))
    found = {r["check_id"]: (r["status"], r["actual"]) for r in results.collect()}
    assert rows == 3 and found["t_clean_k_not_null"] == found["t_clean_code_enum"] == ("PASS", 0)
    assert sorted(r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "1", "2"]
    monkeypatch.setattr(flows, "clean", lambda raw, contract: raw)
    results, rows = flows.clean_check_and_write(raw, contract, str(tmp_path / "raw"))
    found = {r["check_id"]: (r["status"], r["actual"]) for r in results.collect()}
    assert rows == 3 and found["t_clean_code_enum"] == ("ERROR", None) and found["t_clean_k_not_null"] == ("PASS", 0)


def test_dates_in_text(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2030-01-01",), (None,)], "d string")
    checks = [K.Check("old", "", condition="d < DATE '2025-01-01'")]
    row = K.run_checks(df, checks).first()
    assert (row["status"], row["actual"]) == ("FAIL", 1)
    df = df.select(F.to_date("d").alias("d"))
    assert K.run_checks(df, checks).first()["actual"] == 1
    assert df.first()["d"] == datetime.date(2020, 1, 1)
