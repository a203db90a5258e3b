"""Single operators on small inline inputs."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablepact.contract import ColumnRule, TableContract
from tablepact.contracts import ORDERS, ORDERS_DOCUMENT, USERS, USERS_DOCUMENT
from tablepact.functions import coerce as C
from tablepact.functions import predicates as P
from tablepact.functions import text, types
from tablepact.operators import checks as K
from tablepact.operators import clean as CL
from tablepact.operators import consistency as H
from tablepact.operators import compare, framecheck, profile, rowcheck
from tablepact.plans import shapes


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def apply(spark, values, build):
    return [r[0] for r in texts(spark, values).orderBy("i").select(build(F.col("v"))).collect()]


@pytest.mark.parametrize("values, expected", [
    (["1", "2", "3", "-5"], "integer"), (["--5", "7"], "integer"), (["+5"], "float"),
    (["1.5", "2.5", "3.5"], "float"), (["1e5", "nan", "inf", "1_000"], "float"), (["5d"], "string"),
    (["2024-01-15", "2024-02-20", "2024-03-10"], "date"), (["Jan 5, 2024", "05/01/2024"], "date"),
    (["alice", "bob", "charlie"], "string"), (["N/A", "unknown", ""], "string"),
    (["", ""], "integer"), ([None], "unknown"),
    (['{"a": 1}', '{"b": [1, 2]}', "[]"], "json"), (['{"a": 1}', '{"a": 1'], "string"), (["5", "{}"], "string"),
])
def test_type_inference(spark, values, expected):
    assert texts(spark, values).select(profile.inferred_type(F.col("v"))).first()[0] == expected


def test_type_inference_of_nothing(spark):
    assert texts(spark, []).select(profile.inferred_type(F.col("v"))).first()[0] == "unknown"
    no_json = texts(spark, ["{}"]).select(profile.inferred_type(F.col("v"), with_json=False))
    assert no_json.first()[0] == "string"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789+-._eEnaif 'xd", max_size=8), min_size=40, max_size=60))
def test_float_text_agrees_with_python(spark, values):
    def parses(v):
        try:
            float(v)
            return True
        except ValueError:
            return False
    assert apply(spark, values, P.is_float_text) == [parses(v) for v in values]


def test_json_validity(spark):
    cases = {'{"a":1}': True, '{"a":1}xyz': False, '{"a":1} {"b":2}': False, '{"a":1},{"b":2}': False,
             '{"a":1}]{}': False, '{"a":1},"end":0}': False, '{"a":1,"a":2}': True, "{'a':1}": False,
             "5": True, '"x"': True, "": False, "  ": False, '{"a":1': False, "[1 2]": False, "1]": False,
             "1}": False, "tru": False, ' {"a" : [1, 2]} ': True, '{"a":"it\'s"}': True}
    assert dict(zip(cases, apply(spark, list(cases), P.is_valid_json), strict=True)) == cases


def test_dates(spark):
    cases = {"2024-01-15": True, "2024-02-30": False, "not-a-date": False, "bad-date": False, "20240115": True,
             "2024/1/5": True, "13/01/2024": True, "01/13/2024": True, "32/01/2024": False, "5 March 2024": True,
             "2024-01-15 10:00:00": True, "2024-01-15T10:00:00Z": True, "12345": False, "": False}
    assert dict(zip(cases, apply(spark, list(cases), P.is_date_text), strict=True)) == cases


def test_email_forms(spark):
    values = ["a@b.com", "karen@example", "a@b@c.org", "no-at", "@b.c", "a b@c.de"]
    assert apply(spark, values, P.is_email_strict) == [True, False, False, False, False, False]
    assert apply(spark, values, P.is_email_like) == [True, False, True, False, False, True]
    assert apply(spark, values, P.is_email_basic) == [True, False, True, False, True, True]


def test_numbers(spark):
    values = ["1.5", "1e3", " 7 ", "5d", "0x1p3", "1_000", "nan", "inf", "x", None]
    assert apply(spark, values, C.to_double) == [1.5, 1000.0, 7.0, None, None, None, None, float("inf"), None, None]
    assert apply(spark, values, C.to_integer)[:3] == [1, 1000, 7]
    assert apply(spark, ["-1.9", "99999999999", "inf"], C.to_integer) == [-1, None, None]
    bounded = lambda c: C.clamped_integer(c, 4, 0, 10)
    assert apply(spark, ["-3", "12", "7.9", "inf", "1e30", "x", None], bounded) == [0, 10, 7, 10, 10, 4, 4]
    assert apply(spark, ["1e30", "x"], lambda c: C.clamped_integer(c, 4, 0)) == [4, 4]
    assert apply(spark, ["-3", "x", "0.5"], lambda c: C.clamped_double(c, 0.0, 0.0, 0.4)) == [0.0, 0.0, 0.4]
    assert texts(spark, ["5", None]).select(C.clamp(F.col("v").cast("int"), 6, 9)).collect() == [(6,), (None,)]


def test_strings(spark):
    assert apply(spark, ["ab", "abcdef", None], lambda c: C.pad_to(c, 4)) == ["ab  ", "abcdef", None]
    assert apply(spark, ["abcdef"], lambda c: C.truncate_to(c, 3)) == ["abc"]
    assert apply(spark, ["ab1", "zab1", None], lambda c: C.enforce_pattern(c, "ab|cd", "-")) == ["ab1", "-", "-"]
    assert apply(spark, ["a", "z", None], lambda c: C.enforce_enum(c, ["b", "a"])) == ["a", "b", "b"]
    assert apply(spark, ["true", "1", "yes", "no", None], C.to_boolean) == [True, True, True, False, False]
    assert apply(spark, ["karen@example", " a@b.com ", "none", "", "x@y z"],
                 lambda c: C.repair_email_domain(c, "d@e.fg")) == [
        "karen@example.com", "a@b.com", "d@e.fg", "d@e.fg", "d@e.fg"]
    assert apply(spark, ["N/A", "", "null", "ok"], C.na_to_null) == [None, None, None, "ok"]


def test_json_cleaning(spark):
    values = ['{ "b": 1, "a": [1, 2] }', '{"a": 1', "", None, "5", '"x"', "null"]
    assert apply(spark, values, C.clean_json) == ['{"b":1,"a":[1,2]}', "{}", "{}", "{}", "5", '"x"', "null"]
    assert text.json_default_text({"a": 1}) == '{"a": 1}' and text.json_default_text(None) == "{}"


def test_human_size(spark):
    sizes = [100, 1024, 1536, 552 * 1024 + 256, 1024 ** 2, 5 * 1024 ** 3, 1024 ** 5, 3 * 1024 ** 6]
    df = spark.createDataFrame([(s,) for s in sizes], "n long").select(text.human_size(F.col("n")))
    assert [r[0] for r in df.collect()] == ["100.0 B", "1.0 KB", "1.5 KB", "552.2 KB", "1.0 MB", "5.0 GB", "1.0 PB", "3072.0 PB"]


def test_type_names():
    assert types.spark_type("bigint").simpleString() == "bigint"
    assert types.spark_type("uuid").simpleString() == "string"
    assert types.accepted_type_names("date") == ("date", "timestamp", "timestamp_ntz")


def test_contract_lookup(tmp_path):
    assert TableContract.from_document(USERS_DOCUMENT, "users_clean").name == "users"
    with pytest.raises(ValueError):
        TableContract.from_document(USERS_DOCUMENT, "nothing")
    assert TableContract.from_document(USERS_DOCUMENT, "nothing", match="first").name == "users"
    with pytest.raises(ValueError):
        TableContract.from_document({"tables": {}})
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "orders_schema.yaml"
    path.write_text(yaml.safe_dump(ORDERS_DOCUMENT))
    assert TableContract.from_yaml(str(path)) == ORDERS
    rule = ColumnRule.from_dict({"name": "x"})
    assert (rule.nullable_in_comparison, rule.nullable_in_checks) == (False, True)
    assert ORDERS.key == ["order_id"]


def test_verdicts(spark):
    cases = [("> 0", 1, "PASS"), ("> 0", 0, "FAIL"), ("< 5", 4, "PASS"), ("< 5", 5, "FAIL"), ("= 3", 3, "PASS"),
             ("= 3", 2, "FAIL"), ("0", 0, "PASS"), ("0", 1, "FAIL"), ("7", 7, "PASS"), (None, 5, "PASS"),
             ("0", None, "FAIL")]
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(cases)], "i int, e string, a long")
    got = df.orderBy("i").select(K.verdict(F.col("e"), F.col("a"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_checks_stay_independent(spark):
    df = spark.createDataFrame([("5",), ("x",)], "v string")
    found = {r.check_id: r for r in K.run_checks(df, [
        K.Check("a", "", condition="v = 'x'"), K.Check("b", "", condition="nope > 1"),
        K.Check("c", "", condition="v ++ 1"), K.Check("d", "", kind="min", condition="v < 0", column="v"),
        K.Check("e", "", check_type="other"), K.Check("f", "", check_type="row_count")]).collect()}
    assert {k: r.status for k, r in found.items()} == {
        "a": "FAIL", "b": "ERROR", "c": "ERROR", "d": "ERROR", "e": "PASS", "f": "PASS"}
    assert found["e"].details == "Unknown check type: other" and found["b"].error
    summary = K.summary(spark.createDataFrame([("PASS",), ("ERROR",)], "status string")).first()
    assert summary.overall_status == "WARN"
    assert K.source_table_candidates("orders_clean") == ["raw_orders", "raw_orders_clean", "orders"]
    assert K.source_table_candidates("orders_clean", "landing") == ["landing"]


def test_basic_checks_are_a_subset():
    kinds = [c.kind for c in K.basic_checks(ORDERS)]
    assert kinds[0] == "row_count" and "min_length" not in kinds and "date_valid" not in kinds
    assert set(K.basic_checks(ORDERS)) < set(K.generate_checks(ORDERS))


def test_frame_validation_finds_contract_by_columns(spark):
    df = spark.createDataFrame([], "a int, b string")
    contract = TableContract.from_dict("t", {"columns": [{"name": "b"}, {"name": "a", "type": "integer"}]})
    assert framecheck.contract_for_frame(df, {"t": contract}, "t_clean") is contract
    assert framecheck.contract_for_frame(df.drop("a"), {"t": contract}, "t_clean") is None


def test_frame_with_no_measurable_column(spark):
    contract = TableContract.from_dict("t", {"columns": [{"name": "a"}]})
    assert [r.issue for r in framecheck.frame_issues(spark.range(3), contract).orderBy("issue").collect()] == [
        "extra_column", "missing_column"]


def test_reconcile_order(spark):
    def status(source, clean):
        return H.reconcile(spark.range(source), spark.range(clean)).first().status
    assert [status(0, 0), status(5, 5), status(5, 0), status(5, 3), status(3, 5)] == [
        "PASS", "PASS", "FAIL", "WARN", "ERROR"]


def test_throughput(spark):
    df = spark.createDataFrame([(1, 13, 5.23, 45.2), (2, 99_999, 60.0, 1.0), (3, 5000, 1.0, 100.0), (4, 200_000, 90.0, 500.0)],
                               "id int, rows long, seconds double, mb double")
    got = H.throughput_status(df, memory_mb="mb").orderBy("id").collect()
    assert [r.performance_status for r in got] == ["WARN", "FAIL", "FAIL", "FAIL"]
    roomy = H.throughput_status(df, memory_mb="mb", max_memory_mb=300.0).orderBy("id").collect()
    assert roomy[3].performance_status == "PASS"


def test_severity_rollup(spark):
    def overall(*rows):
        return H.severity_status(spark.createDataFrame(list(rows), "status string, severity string")).first().overall_status
    assert overall(("FAIL", "critical"), ("FAIL", "high")) == "FAIL"
    assert overall(("FAIL", "high"), ("PASS", "critical")) == "WARN"
    assert overall(("FAIL", "medium")) == "PASS"


def test_multiset_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    got = {r.v: (r.left_count, r.right_count) for r in shapes.multiset_difference(a, b).collect()}
    assert got == {1: (2, 1), 3: (0, 1)}


def test_deduplicate_keeps_smallest(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, None), (2, None, "z")], "k int, o int, v string")
    assert {tuple(r) for r in CL.deduplicate(df, ["k"], ["o"]).collect()} == {(1, 5, "a"), (2, None, "z")}
    assert CL.deduplicate(df.select("k"), ["k"]).count() == 2


def test_hot_group_samples_stay_small(spark):
    """One group holds nearly every row; the rank filter limits it before the shuffle."""
    errors = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("column"), F.lit("e").alias("error"),
        F.lit("high").alias("severity"), F.format_string("%05d", "id").alias("value"))
    found = {r.column: r for r in rowcheck.root_causes(errors).collect()}
    assert found["a"].rows_affected == 19_800 and found["a"].sample_values[0] == "00001"
    assert found["b"].sample_values == ["00000", "00100", "00200", "00300", "00400"]
    plan = shapes.smallest_values(errors, ["column"], "value", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_quality_report_without_rows(spark):
    report = profile.quality_report(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.total, r.distinct_count, r.null_count, r.null_percentage) for r in report] == [(0, 0, 0, 0.0)] * 2


def test_quality_report_small(spark):
    df = spark.sql("SELECT 1 AS id, 'test' AS name")
    report = profile.quality_report(df)
    assert report.count() == 2 and profile.quality_issues(report).count() == 0
    nulls = spark.sql("SELECT * FROM VALUES (1, NULL), (2, NULL), (NULL, 'x') AS t(a, b)")
    found = {r.column: r.severity for r in profile.quality_issues(profile.quality_report(nulls)).collect()}
    assert found == {"a": "medium", "b": "high"}


def test_sql_statement():
    issues = {"total_amount": ["type_mismatch"], "shipping_address": ["nullability_mismatch", "null_values_found"]}
    sql = CL.cleaning_statement(ORDERS, issues, "raw_orders")
    assert sql.startswith("INSERT INTO orders_clean (`order_id`, `customer_id`")
    assert "COALESCE(TRY_CAST(`total_amount` AS double), CAST(0.0 AS double)) AS `total_amount`" in sql
    assert "COALESCE(`shipping_address`, 'unknown') AS `shipping_address`" in sql


def test_date_formats(spark):
    contract = TableContract.from_dict("t", {"columns": [{"name": "v", "type": "date", "default": "1970-01-01"}]})
    df = CL.clean(texts(spark, ["05/02/2024", "2024-02-05", "x"]).select("v"), contract,
                  date_formats=("yyyy-MM-dd", "dd/MM/yyyy"))
    assert [r.v for r in df.collect()] == [datetime.date(2024, 2, 5)] * 2 + [datetime.date(1970, 1, 1)]


def test_columns_without_default_are_named():
    assert CL.null_coercion_report(ORDERS) == ["order_id", "customer_id"]


def test_result_filters(spark):
    results = spark.createDataFrame(
        [("a", "FAIL", "critical"), ("b", "FAIL", "high"), ("c", "ERROR", "critical"), ("d", "PASS", "critical")],
        "check_id string, status string, severity string")
    ids = lambda df: [r.check_id for r in df.orderBy("check_id").collect()]
    assert (ids(K.failed(results)), ids(K.errored(results)), ids(K.critical_failures(results))) == (
        ["a", "b"], ["c"], ["a"])


def test_frame_messages(spark):
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "n", "type": "integer", "nullable": False, "constraints": {"min": 0, "max": 9}},
        {"name": "s", "type": "string", "enum": ["x", "y"], "constraints": {"max_length": 2}},
        {"name": "e", "type": "string", "format": "email"}, {"name": "gone", "type": "string"}]})
    df = spark.createDataFrame([(None, "zzz", "a@b"), (-1, "x", "a@b.cd"), (12, "w", None)],
                               "n int, s string, e string").withColumn("extra", F.lit(1.5))
    found = {(r.column, r.issue): r for r in framecheck.frame_issues(df, contract).collect()}
    assert {k: r.message for k, r in found.items()} == {
        ("n", "null_values"): "Column has 1 null values but is defined as NOT NULL",
        ("n", "below_min"): "1 values below minimum 0", ("n", "above_max"): "1 values above maximum 9",
        ("s", "invalid_enum"): "2 values not in allowed enum: ['x', 'y']",
        ("s", "too_long"): "1 values longer than maximum length 2",
        ("e", "invalid_email"): "1 values have invalid email format",
        ("gone", "missing_column"): "Column 'gone' missing from cleaned data",
        ("extra", "extra_column"): "Extra column 'extra' not in ideal schema"}
    assert found["s", "invalid_enum"].examples == ["w", "zzz"]
    assert (found["n", "below_min"].actual, found["n", "above_max"].actual) == ("-1.0", "12.0")
    summary = framecheck.frame_summary(df, contract).first()
    assert (summary.row_count, summary.issue_count, summary.is_valid) == (3, 8, False)


MESSY = st.one_of(
    st.none(), st.text(max_size=12), st.sampled_from(["", "N/A", "nan", "inf", "-inf", "1e400", "5d", "--5", "1_0", " 7 "]),
    st.integers(-10**12, 10**12).map(str), st.floats(allow_nan=False).map(str),
    st.dates(datetime.date(1, 1, 1)).map(str), st.emails(), st.sampled_from(["active", "closed", "pending"]),
    st.sampled_from(['{"a": [1, "]"]}', "{'a': 1}", '{"a"', "[]", "null", "{}x"]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[MESSY] * 8), min_size=25, max_size=50))
def test_cleaning_properties(spark, rows):
    """Whatever comes in: rows are kept, all checks pass, cleaning again changes nothing."""
    usable = [(str(i), *row[1:]) for i, row in enumerate(rows)]
    raw = spark.createDataFrame(usable, ", ".join(f"{n} string" for n in USERS.names))
    cleaned = CL.clean(raw, USERS)
    assert cleaned.count() == len(rows)
    failures = K.run_checks(cleaned, K.generate_checks(USERS)).filter("status <> 'PASS'").collect()
    assert failures == []
    assert shapes.multiset_difference(CL.clean(cleaned, USERS), cleaned).count() == 0


def test_recommendation_without_default(spark):
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "v", "type": "integer"}, {"name": "w", "type": "string", "default": "it's"}]})
    df = spark.createDataFrame([("x", ""), ("", "b")], "v string, w string")
    rows = {(r.column, r.action): r for r in compare.explode_recommendations(
        compare.compare_schema(df, contract)).collect()}
    assert rows["v", "cast"].code == "COALESCE(CAST(v AS INTEGER), NULL)" and rows["v", "cast"].default is None
    assert set(rows) == {("v", "cast"), ("w", "coalesce"), ("w", "fill_nulls")}
    assert rows["w", "fill_nulls"].code == 'COALESCE(w, "it\'s")'
    bare = TableContract.from_dict("t", {"columns": [{"name": "v", "type": "integer"}]})
    assert compare.explode_recommendations(compare.compare_schema(df, bare)).count() == 1


def test_long_keys_give_the_same_duplicates(spark):
    df = spark.range(3000).select(F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)).alias("k"))
    narrow, wide = H.duplicate_keys(df, ["k"]), H.duplicate_keys(df, ["k"], wide=True)
    assert narrow.count() > 0 and shapes.multiset_difference(narrow, wide).count() == 0
    with_null = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    for flag in (False, True):
        assert [tuple(r) for r in H.duplicate_keys(with_null, ["k"], wide=flag).collect()] == [(None, 2)]


def test_digest_report_is_the_exact_report(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (1, 'a', NULL), (2, 'b', NULL) AS t(n, s, u)")
    exact, digest = profile.quality_report(df), profile.quality_report(df, distinct="digest")
    assert shapes.multiset_difference(exact, digest.select(*exact.columns)).count() == 0
    with pytest.raises(ValueError):
        profile.quality_report(df, distinct="some")
