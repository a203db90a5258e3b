"""Expected results on the three sample tables."""

import json

import pytest
from pyspark.sql import functions as F
from samples import ORDERS_CSV, ROWS, TRANSACTIONS_CSV, USERS_CSV

from tablepact.contracts import ORDERS, ROW_CHECK_USERS, TRANSACTIONS, USERS
from tablepact.functions import predicates as P
from tablepact.operators import checks as K
from tablepact.operators import clean as CL
from tablepact.operators import compare, consistency, framecheck, profile, rowcheck
from tablepact.plans import flows
from tablepact.sources import files, strict


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("samples")
    out = {}
    for name, text in (("users", USERS_CSV), ("orders", ORDERS_CSV), ("transactions", TRANSACTIONS_CSV)):
        file = folder / f"{name}.csv"
        file.write_text(text)
        out[name] = str(file)
    return out


@pytest.fixture(scope="module")
def raw(spark, paths):
    return {name: files.stage_csv(spark, path) for name, path in paths.items()}


CONTRACTS = {"users": USERS, "orders": ORDERS, "transactions": TRANSACTIONS}


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_staging_keeps_every_row_as_text(raw):
    for name, df in raw.items():
        assert df.count() == ROWS[name]
        assert {f.dataType.simpleString() for f in df.schema} == {"string"}
        assert df.columns == CONTRACTS[name].names
    assert raw["users"].filter("id = 4").first().metadata == '{"lang": "sv", "size": '


INFERRED = {
    "users": dict(id="integer", name="string", email="string", age="string", join_date="date",
                  status="string", score="float", metadata="string"),
    "orders": dict(order_id="integer", customer_id="integer", order_date="string", total_amount="string",
                   shipping_address="string", item_count="integer"),
    "transactions": dict(transaction_id="integer", customer_id="integer", amount="string", date="string",
                         category="string", status="string"),
}


@pytest.mark.parametrize("name", list(INFERRED))
@pytest.mark.parametrize("sample", [100, None])
def test_inferred_types(raw, name, sample):
    found = by(profile.infer_schema(raw[name], sample), "column")
    assert {c: r.type for c, r in found.items()} == INFERRED[name]
    assert all(r.row_count == ROWS[name] for r in found.values())


def test_inferred_nulls_and_samples(raw):
    found = by(profile.infer_schema(raw["users"], order_by=[F.col("id").cast("int")]), "column")
    assert found["email"].null_count == 1 and found["email"].nullable
    assert found["email"].null_percentage == pytest.approx(1 / 8)
    assert found["metadata"].null_count == 2
    assert found["age"].sample_values == ["61", "19", "N/A", "47", "38"]


def statuses(df, contract):
    compared = compare.compare_profile(profile.infer_schema(df), contract)
    rows = compared.orderBy("position").collect()
    return ({r.column: r.status for r in rows},
            {r.column: [i["type"] for i in r.issues] for r in rows if r.issues})


def test_compare_users(raw):
    status, issues = statuses(raw["users"], USERS)
    assert [c for c, s in status.items() if s == "match"] == ["id", "name", "join_date", "status", "score"]
    assert issues == {"email": ["nullability_mismatch", "null_values_found"], "age": ["type_mismatch"],
                      "metadata": ["type_mismatch"]}


def test_compare_orders(raw):
    status, issues = statuses(raw["orders"], ORDERS)
    assert [c for c, s in status.items() if s == "match"] == ["order_id", "customer_id"]
    both = ["nullability_mismatch", "null_values_found"]
    assert issues == {"order_date": ["type_mismatch"], "total_amount": ["type_mismatch"],
                      "shipping_address": both, "item_count": both}


def test_compare_transactions(raw):
    status, issues = statuses(raw["transactions"], TRANSACTIONS)
    assert [c for c, s in status.items() if s == "match"] == ["transaction_id", "customer_id", "status"]
    assert set(issues) == {"amount", "date", "category"}


def test_compare_reports_missing_and_extra(raw):
    status, _ = statuses(raw["users"].drop("score").withColumn("note", F.lit("x")), USERS)
    assert status["score"] == "missing" and status["note"] == "extra"


def test_recommendations(raw):
    compared = compare.compare_profile(profile.infer_schema(raw["users"]), USERS)
    rows = {(r.column, r.action): r for r in compare.explode_recommendations(compared).collect()}
    assert rows["age", "cast"].code == "COALESCE(CAST(age AS INTEGER), 0)"
    assert rows["email", "coalesce"].code == 'COALESCE(email, "unknown@example.com")'
    assert rows["email", "fill_nulls"]["count"] == 1
    merged = compare.compare_profile(profile.infer_schema(raw["users"]), USERS, merged=True)
    assert {r.action for r in compare.explode_recommendations(merged).collect()} == {"cast", "coalesce"}


def test_row_check(raw):
    rows = files.with_line_numbers(raw["users"])
    found = rowcheck.first_errors(rowcheck.check_rows(rows, ROW_CHECK_USERS, "row_number")).collect()
    assert [(r.row, r.column, r.severity) for r in found] == [
        (2, "email", "high"), (3, "age", "high"), (5, "email", "medium")]
    assert found[1].error == "Type mismatch: expected integer, got str" and found[1].value == "N/A"
    summary = rowcheck.check_summary(raw["users"], ROW_CHECK_USERS).first()
    assert (summary.total_rows, summary.total_errors) == (8, 3)
    assert summary.error_rate == pytest.approx(3 / 8)


def test_row_check_of_missing_column(raw):
    found = rowcheck.check_rows(raw["users"].drop("name"), ROW_CHECK_USERS, "id").filter("column = 'name'")
    assert found.count() == 8


def test_staging_counters(raw):
    assert tuple(profile.order_counters(
        raw["orders"], ["shipping_address", "item_count"], "total_amount", "order_date").first()) == (2, 1, 1, 1)
    t = raw["transactions"]
    assert tuple(profile.count_matching(t, {
        "blank": P.is_blank(F.col("category")), "invalid": F.col("amount") == P.INVALID_LITERAL,
        "negative": P.is_negative_text(F.col("amount")), "dates": P.is_not_dashed_date(F.col("date")),
        "status": ~P.in_values(F.col("status"), TRANSACTIONS.column("status").enum)}).first()) == (2, 1, 1, 0, 1)
    age = F.col("age")
    assert tuple(profile.count_matching(raw["users"], {
        "like": P.lacks_digit(age, True), "regex": P.lacks_digit(age)}).first()) == (8, 1)


def test_clean_users(raw):
    rows = by(CL.clean(raw["users"], USERS), "id")
    source = by(raw["users"], "id")
    assert len(rows) == 8
    assert rows[2].email == rows[5].email == "unknown@example.com"
    assert rows[3].age == 0
    assert rows[3].metadata == rows[4].metadata == rows[7].metadata == "{}"
    for key, row in rows.items():
        before = source[str(key)]
        assert (row.name, row.status) == (before.name, before.status)
        assert str(row.join_date) == before.join_date and row.score == float(before.score)
        if key not in (3, 4, 7):
            assert json.loads(row.metadata) == json.loads(before.metadata)
        if key not in (2, 5):
            assert row.email == before.email
        if key != 3:
            assert row.age == int(before.age)


def test_clean_orders(raw):
    rows = by(CL.clean(raw["orders"], ORDERS), "order_id")
    assert len(rows) == 9
    assert [k for k, r in rows.items() if r.total_amount == 0.0] == [1, 4, 5]
    assert [k for k, r in rows.items() if r.shipping_address == "unknown"] == [6, 8]
    assert rows[2].item_count == 1 and rows[5].item_count == 6
    assert str(rows[3].order_date) == "1970-01-01" and str(rows[1].order_date) == "2023-09-01"


def test_clean_transactions(raw):
    rows = by(CL.clean(raw["transactions"], TRANSACTIONS), "transaction_id")
    assert [k for k, r in rows.items() if r.amount == 0.0] == [2, 4, 5]
    assert [k for k, r in rows.items() if r.category == "unknown"] == [3, 8]
    assert str(rows[6].date) == "1970-01-01"
    assert rows[7].status == "pending"


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_cleaning_passes_all_checks_and_is_stable(raw, name):
    contract = CONTRACTS[name]
    cleaned = CL.clean(raw[name], contract)
    results = K.run_checks(cleaned, K.generate_checks(contract, contract.output_table))
    assert results.filter("status <> 'PASS'").count() == 0
    assert framecheck.frame_issues(cleaned, contract).count() == 0
    again = CL.clean(cleaned, contract)
    assert again.exceptAll(cleaned).count() == 0 and cleaned.exceptAll(again).count() == 0


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_cleaning_with_comparison_agrees(raw, name):
    """Fills decided by the comparison give what the per-value rules give."""
    contract = CONTRACTS[name]
    found = compare.issues_by_column(compare.compare_profile(profile.infer_schema(raw[name]), contract))
    one, other = CL.clean(raw[name], contract), CL.clean(raw[name], contract, issues=found)
    assert one.exceptAll(other).count() == 0


@pytest.mark.parametrize("name, count", [("users", 26), ("orders", 20), ("transactions", 19)])
def test_number_of_generated_checks(name, count):
    checks = K.generate_checks(CONTRACTS[name])
    assert len(checks) == count == len({c.check_id for c in checks})
    assert checks[0].query == f"SELECT count(*) FROM {name}"


def test_strict_ingestion_fails_whole(spark, paths, raw, tmp_path):
    for name, contract in CONTRACTS.items():
        target = str(tmp_path / name)
        outcome = flows.ingest_strict(spark, paths[name], contract, target)
        assert not outcome.loaded and outcome.rows == 0 and outcome.error
        assert not files.path_exists(spark, target)
        assert outcome.rejects.count() > 0
    good, bad = strict.split_rejects(raw["orders"], ORDERS)
    assert {r.order_id for r in bad.collect()} == {"1", "2", "3", "6", "8"}
    assert strict.strict_load_to(good, ORDERS, str(tmp_path / "good")) == 4
    loaded = spark.read.parquet(str(tmp_path / "good"))
    assert loaded.columns == [*ORDERS.names, "created_at"] and loaded.count() == 4


def test_validate_output_flow(spark, raw, tmp_path):
    cleaned = CL.clean(raw["users"], USERS)
    for _ in range(2):  # the second run uses the stored checks
        report = flows.validate_output(spark, USERS, cleaned, str(tmp_path), raw["users"]).first()
        assert (report.overall_status, report.total_checks, report.checks_passed) == ("PASS", 26, 26)
        assert (report.source_row_count, report.output_row_count) == (8, 8)
        assert len(report.check_results) == 26


def test_clean_check_and_write(spark, raw, tmp_path):
    path = str(tmp_path / "users")
    results, rows = flows.clean_check_and_write(raw["users"], USERS, path)
    assert rows == 8 and spark.read.parquet(path).count() == 8
    assert results.filter("status = 'PASS'").count() == 26


def test_measured_write(spark, raw, tmp_path):
    metrics = flows.measured_write(CL.clean(raw["orders"], ORDERS), str(tmp_path / "m"))
    verdict = consistency.throughput_status(metrics).first()
    assert verdict.rows == 9 and verdict.seconds > 0 and verdict.performance_status in ("PASS", "WARN")
