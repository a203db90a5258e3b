"""Log tails, digests of tables and filters of repeated keys: results, and what they do not read or move."""

import pytest
from pyspark.sql import functions as F

from tablepact.operators import consistency
from tablepact.plans import shapes
from tablepact.sources import files


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    yield
    spark.conf.set(key, before)


def tasks_of(spark, group, run):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i is not None)


@pytest.mark.parametrize("n", [1, 5, 1000, 2500, 100_000])
def test_tail_over_blocks(spark, tmp_path, small_blocks, n):
    lines = [f"{i} " + "x" * (i % 40) for i in range(30_000)]
    (tmp_path / "a.log").write_text("\n".join(lines[:25_000]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(lines[25_000:27_000]))
    (tmp_path / "c.log").write_text("\n".join(lines[27_000:]) + "\n")
    (tmp_path / "d.log").touch()
    assert [r.line for r in files.read_log(spark, str(tmp_path), n).collect()] == lines[-n:]


def test_tail_reads_few_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "a.log").write_text("".join(f"{i:08d} some line\n" for i in range(200_000)))  # 3.6 MB, 180 blocks
    blocks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    rows, tasks = tasks_of(spark, "tail", lambda: files.read_log(spark, str(tmp_path), 100))
    assert [r.line for r in rows.collect()][-1] == "00199999 some line" and blocks > 100 and tasks <= 4


def test_digests_tell_rows_apart(spark):
    rows = [(None, "a", 1.0), ("a", None, 1.0), (None, None, None), ("a", "a", -0.0), ("a", "a", float("nan"))]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert df.select(shapes.row_digest(df, df.columns).alias("d")).distinct().count() == 5
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "z double")
    assert zeros.select(shapes.row_digest(zeros, ["z"]).alias("d")).distinct().count() == 1


def test_difference_through_digests(spark, no_broadcast):
    a = spark.range(5000).selectExpr("id % 1700 AS k", "cast(id % 7 AS string) AS v", "if(id % 11 = 0, null, id % 5) AS w")
    b = a.where("k <> 3").unionByName(a.where("k = 8")).withColumn("v", F.when(F.col("k") != 900, F.col("v")))
    plain = {tuple(r) for r in shapes.multiset_difference(a, b).collect()}
    assert plain and {tuple(r) for r in shapes.multiset_difference(a, b, 64).collect()} == plain
    assert consistency.idempotency(a, b).first()["differing_rows"] == len(plain)


def test_equal_tables_exchange_buckets_only(spark, no_broadcast):
    a = spark.range(20_000).selectExpr("id AS k", "repeat(cast(id AS string), 20) AS v")
    found = consistency.idempotency(a, a.orderBy(F.desc("k")))
    row = found.first()
    assert (row["differing_rows"], row["status"]) == (0, "PASS")
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    text = plan.toString()
    moved = [line for line in text.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(k" in line]
    assert not moved, moved


def test_repeated_keys_by_filter(spark, no_broadcast):
    df = spark.range(3000).selectExpr("repeat(cast(id % 2900 AS string), 30) AS t", "id % 2900 AS k")
    some = df.unionByName(spark.createDataFrame([(None, 1), (None, 1), ("", 2)], df.schema))
    for keys in (["t"], ["t", "k"]):
        want = {tuple(r) for r in consistency.duplicate_keys(some, keys).collect()}
        assert {tuple(r) for r in consistency.duplicate_keys(some, keys, wide=True).collect()} == want
    left = shapes.repeated_only(some.select("t"), ["t"])
    assert left.count() < 260  # 202 rows repeat
    tiny = shapes.repeated_only(some.select("t"), ["t"], words=1)
    assert tiny.groupBy("t").count().where("count > 1").count() == 101


def test_unique_texts_are_not_shuffled(spark, no_broadcast):
    df = spark.range(1000).selectExpr("repeat(cast(id AS string), 30) AS t")
    plan = consistency.duplicate_keys(df, ["t"], wide=True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(t" in line]
    assert len(exchanges) == 1 and plan.index("Exchange hashpartitioning(t") < plan.index("BroadcastHashJoin")


def test_line_numbers_by_hashed_names(spark, tmp_path, small_blocks):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(9000)))
    rows = files.with_line_numbers(spark.read.text(str(tmp_path))).collect()
    want = [f"{i}-{j}" for i in range(3) for j in range(9000)]
    assert {r["row_number"]: r["value"] for r in rows} == dict(enumerate(want, 1))


def test_first_values_without_a_sort(spark):
    from tablepact.operators import profile
    df = spark.range(5000).selectExpr("id", "if(id > 4000, cast(id AS string), null) AS late", "cast(null AS string) AS never")
    for order in ((), ("id",), (-F.col("id"),)):
        found = profile._first_filled(df, order, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert " Sort " not in plan and "Window" not in plan
        rows = {r["column"]: r["sample_values"] for r in found.collect()}
        assert len(rows["id"]) == len(rows["late"]) == 5 and rows["never"] == []
    assert rows["late"] == ["4999", "4998", "4997", "4996", "4995"] or sorted(rows["late"]) == ["4995", "4996", "4997", "4998", "4999"]


def test_runs_are_compared_in_one_read_of_each(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS v").write.parquet(str(tmp_path / "run"))
    run = spark.read.parquet(str(tmp_path / "run"))
    other = run.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")))
    verdict = consistency.idempotency(run, other)
    assert tuple(verdict.first()) == (1000, "FAIL")
    plan = verdict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    widened = run.withColumn("v", F.col("v").cast("int"))
    assert tuple(consistency.idempotency(run, widened).first()) == (0, "PASS")
