"""Files, catalog, sinks, logs, streaming and attempt analytics."""


import pytest
from pyspark.sql import functions as F

from tablepact.contract import TableContract
from tablepact.operators import attempts as A
from tablepact.operators import checks as K
from tablepact.operators import logs
from tablepact.plans.ordered import checkpoint_dir
from tablepact.sources import catalog, files, sinks, strict
from tablepact.streaming import logs as live

KEYED = TableContract.from_dict("t", {"columns": [
    {"name": "id", "type": "integer", "nullable": False, "primary_key": True},
    {"name": "v", "type": "float", "nullable": True}]})


def test_source_validation(spark, tmp_path):
    good, empty = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text("x\n1\n")
    empty.write_text("")
    assert files.validate_source(spark, str(good))["size_bytes"] == 4
    with pytest.raises(FileNotFoundError):
        files.validate_source(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="empty"):
        files.validate_source(spark, str(empty))
    with pytest.raises(ValueError, match="not a file"):
        files.validate_source(spark, str(tmp_path))
    meta = files.file_metadata(spark, str(good)).first()
    assert (meta.size_bytes, meta.size_human, meta.is_file) == (4, "4.0 B", True)
    assert files.path_metadata(spark, str(tmp_path))["is_directory"]
    assert files.path_metadata(spark, str(tmp_path / "none")) == {"path": str(tmp_path / "none"), "exists": False}


def test_inspect_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x,y\n" + "".join(f"{i},{i}\n" for i in range(30)))
    described, sample = files.inspect_file(spark, str(path), 10)
    row = described.first()
    assert (row.rows, row.columns) == (10, ["x", "y"]) and sample.count() == 10


def test_line_numbers_and_tail_over_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(1, 5001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.stage_csv(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        numbered = files.with_line_numbers(rows)
        assert numbered.filter(F.col("row_number") != F.col("n").cast("long")).count() == 0
        assert numbered.count() == 5000
        assert [r.line for r in files.read_log(spark, str(path), 3).collect()] == ["4998", "4999", "5000"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_read_rows_keeps_empty_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,\n,""\n')
    assert [tuple(r) for r in files.read_rows(spark, str(path)).collect()] == [("1", ""), ("", "")]
    assert [tuple(r) for r in files.stage_csv(spark, str(path)).collect()] == [("1", None), (None, None)]


def test_strict_load(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(list(values), "id string, v string")
    loaded = strict.strict_load(rows(("1", "2.5"), ("2", "")), KEYED)
    assert [(r.id, r.v) for r in loaded.orderBy("id").collect()] == [(1, 2.5), (2, None)]
    for bad, message in ((rows(("1", "x")), "Conversion failed: t.v to float"), (rows(("", "1")), "NOT NULL"),
                         (rows(("1", "1"), ("1", "2")), "PRIMARY KEY")):
        with pytest.raises(Exception, match=message):
            strict.strict_load(bad, KEYED).collect()
    # the assertions hold even when only some columns are read
    with pytest.raises(Exception, match="NOT NULL"):
        strict.strict_load(rows(("", "1")), KEYED).select("v").collect()
    with pytest.raises(Exception, match="Conversion"):
        strict.strict_load(rows(("1", "x")), KEYED).select("id").collect()
    with pytest.raises(Exception, match="PRIMARY KEY"):
        strict.strict_load(rows(("1", "1"), ("1", "2")), KEYED).count()


def test_failed_load_leaves_the_target(spark, tmp_path):
    target = str(tmp_path / "t")
    good = spark.createDataFrame([("1", "1"), ("2", "2")], "id string, v string")
    assert strict.strict_load_to(good, KEYED, target) == 2
    with pytest.raises(Exception, match="PRIMARY KEY"):
        strict.strict_load_to(good.unionAll(good), KEYED, target)
    assert spark.read.parquet(target).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert strict.strict_load_to(good.limit(1), KEYED, target) == 1


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("three")
    got = {r.table: (r.row_count, r.status) for r in catalog.table_status(spark, ["three", "absent"]).collect()}
    assert got == {"three": (3, "ok"), "absent": (None, "error")}
    assert "three" in {r.table for r in catalog.table_status(spark).collect()}


def test_adhoc_queries(spark):
    spark.range(250).createOrReplaceTempView("many")
    result = catalog.run_query(spark, "SELECT id FROM many ORDER BY id DESC; ")
    assert (result.columns, result.row_count(), result.rows.count()) == (["id"], 250, 100)
    assert result.rows.first().id == 249
    assert catalog.run_query(spark, "SELECT 1 AS id, 'test' AS name -- note").rows.first().name == "test"
    assert catalog.run_query(spark, "SHOW TABLES").error is None
    for bad in ("SELECT nope FROM many", "DROP VIEW many", "INSERT INTO many VALUES (1)", "",
                "WITH x AS (SELECT 1 AS id) INSERT INTO many SELECT * FROM x", "CREATE TABLE z AS SELECT 1"):
        result = catalog.run_query(spark, bad)
        assert result.error and result.row_count() is None
    assert spark.table("many").count() == 250


def test_save_clean_counts_rows(spark):
    assert sinks.save_clean(spark.range(7), "seven_clean") == 7
    assert sinks.save_clean(spark.range(5), "seven_clean") == 5
    assert spark.table("seven_clean").count() == 5
    assert K.find_source(spark, "nothing_clean") is None


def test_attempt_log(spark, tmp_path):
    path = str(tmp_path / "attempts")
    row = spark.createDataFrame([("2024-01-01T00:00:00", "users", "execution", False, "x" * 1500, 1)], sinks.ATTEMPT_SCHEMA)
    sinks.append_attempts(row, path)
    sinks.append_attempts(row, path, max_error_length=1000)
    back = sinks.read_attempts(spark, path)
    assert sorted(len(r.error) for r in back.collect()) == [1000, 1500]


LOG = ["2024-01-01 10:00:00 - ERROR - first failed", "2024-01-01 11:00:00 - WARNING - careful",
       "no stamp ERROR here", "2024-01-01 11:30:00 - INFO - fine", "2024-13-01 00:00:00 ERROR bad stamp",
       "2023-12-30 00:00:00 ERROR too old"]


def test_recent_errors(spark):
    lines = spark.createDataFrame([(x,) for x in LOG], "line string")
    got = logs.recent_errors(lines, 24, "2024-01-02 00:00:00").orderBy("timestamp").collect()
    assert [(r.timestamp, r.level) for r in got] == [
        ("2024-01-01 10:00:00", "ERROR"), ("2024-01-01 11:00:00", "WARNING")]
    assert logs.error_count(logs.recent_errors(lines, 1, "2024-01-01 11:30:00")).first()[0] == 1


def test_error_classes(spark):
    lines = spark.createDataFrame([(m,) for m in (
        "ConversionException: x", "NOT NULL constraint failed", "UNIQUE constraint", "File not found: a",
        "Connection refused", "odd", "odd too")], "message string")
    assert {r.error_class: r.error_count for r in logs.error_classes(lines).collect()} == {
        "type mismatch": 1, "null in required field": 1, "duplicate values": 1, "missing source file": 1,
        "connection issue": 1, "other": 2}


def test_stream_over_arriving_files(spark, tmp_path):
    """Two runs of the same query: the second sees only the new file and adds to the window."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.log").write_text("\n".join(LOG[:4]) + "\n")

    def run():
        windows = live.level_windows(live.stream_lines(spark, str(source)), "1 hour", "2 days")
        live.write_windows(windows, out, state).awaitTermination()
        return {(r.window_start.hour, r.level): r.line_count for r in live.latest_windows(spark, out).collect()}

    assert run() == {(10, "ERROR"): 1, (11, "WARNING"): 1}
    (source / "b.log").write_text("2024-01-01 10:59:59 error again\n")
    assert run() == {(10, "ERROR"): 2, (11, "WARNING"): 1}


def test_streamed_lines_without_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("\n".join(LOG) + "\n")
    query = (live.error_lines(live.stream_lines(spark, str(source), max_files=1)).writeStream.format("memory")
             .queryName("error_lines").trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("error_lines").count() == 3


def log_frame(spark, rows):
    return spark.createDataFrame([(i, p, t, e) for i, (p, t, e) in enumerate(rows)],
                                 "seq long, pipeline string, type string, error string")


def history(spark, rows, **options):
    return A.attempt_history(log_frame(spark, rows), **options).orderBy("seq")


def test_limits(spark):
    rows = [("users", "regeneration", None)] * 4 + [("users", "execution", None)] * 3
    got = [r[0] for r in history(spark, rows).select(A.is_allowed()).collect()]
    assert got == [True, True, True, False, True, True, False]
    many = [(f"p{i}", "regeneration", None) for i in range(4)]
    assert [r[0] for r in history(spark, many).select(A.is_allowed()).collect()] == [True, True, True, False]
    limits = A.Limits(max_regenerations=99, max_total_attempts=5)
    six = [("a", "regeneration", None)] * 6
    assert [r[0] for r in history(spark, six).select(A.is_allowed(limits)).collect()] == [True] * 5 + [False]


def test_limit_messages(spark):
    rows = [("users", "regeneration", None)] * 4
    got = [r[0] for r in history(spark, rows).select(A.limit_message(A.Limits(max_total_attempts=3))).collect()]
    assert got[0] == "Within limits for users"
    assert got[3] == ("Max regenerations (3) exceeded for users: 4 attempts | "
                      "Max total attempts (3) exceeded: 4 attempts")


def test_repeated_errors(spark):
    rows = [("a", "execution", "TEST ERROR"), ("a", "execution", "test error"), ("b", "execution", "test error"),
            ("a", "execution", None), ("a", "execution", "Test  error\n\t"), ("a", "execution", "other")]
    got = [r[0] for r in history(spark, rows).select(A.is_repeated_error()).collect()]
    assert got == [False, True, False, False, True, False]


def test_backoff(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (10,)], "n int")
    assert [r[0] for r in df.select(A.backoff_seconds(F.col("n"))).collect()] == [0.5, 1.0, 2.0, 4.0, 5.0]


def test_history_does_not_depend_on_ranges(spark):
    """A pipeline with most of the rows, over one, few and many ranges."""
    rows = [("hot" if i % 10 else f"p{i % 3}", "execution" if i % 2 else "regeneration",
             f"e{i % 7}" if i % 4 == 0 else None) for i in range(2000)]
    expected, counts, errors, pipelines = [], {}, {}, set()
    for i, (p, t, e) in enumerate(rows):
        pipelines.add(p)
        counts[p, t] = counts.get((p, t), 0) + 1
        expected.append((i, counts.get((p, "regeneration"), 0), counts.get((p, "execution"), 0),
                         i + 1, len(pipelines), errors.get(p)))
        if e:
            errors[p] = e
    for ranges in (1, 3, 16):
        got = history(spark, rows, ranges=ranges).select(
            "seq", "regeneration_attempts", "execution_attempts", "total_attempts", "total_pipelines", "last_error")
        assert [tuple(r) for r in got.collect()] == expected


def test_error_history(spark):
    rows = [("a", "execution", "x"), ("b", "execution", "y"), ("a", "regeneration", None), ("a", "execution", "z")]
    got = A.error_history(history(spark, rows), "a").collect()
    assert [(r.attempt_num, r.error) for r in got] == [(1, "x"), (2, "z")]
    assert A.pipeline_totals(log_frame(spark, rows)).count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_observed_metrics(spark, tmp_path):
    seen = sinks.observed_write(spark.range(10), str(tmp_path / "o"), {"top": F.max("id"), "n": F.count(F.lit(1))})
    assert seen == {"top": 9, "n": 10}
