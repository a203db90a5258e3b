"""Streams with versioned state: attempts and log windows over many batches, restarts and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from tablepact.operators import attempts as A
from tablepact.streaming import attempts, logs
from tablepact.streaming.versions import Versions

SCHEMA = "seq long, pipeline string, type string, error string"


def attempt_rows(n=120):
    draw = random.Random(3)
    return [(i, draw.choice(["a", "b", None, f"p{i // 30}"]), draw.choice(A.ATTEMPT_TYPES), draw.choice([None, "", "Cast  FAILED", "cast failed"]))
            for i in range(n)]


def test_attempts_over_batches_equal_the_whole_log(spark, tmp_path):
    rows, inbox = attempt_rows(), str(tmp_path / "in")
    log = spark.createDataFrame(rows, SCHEMA)
    limits = A.Limits(5, 4, 3, 60)
    cuts = [0, 1, 7, 50, 51, 120]
    for a, b in zip(cuts, cuts[1:]):
        log.where(F.col("seq").between(a, b - 1)).write.mode("append").parquet(inbox)
        attempts.watch(spark.readStream.schema(SCHEMA).parquet(inbox), str(tmp_path / "out"), str(tmp_path / "state"),
                       limits=limits).awaitTermination()
    whole = A.attempt_history(log).select("*", A.is_allowed(limits).alias("allowed"))
    found = attempts.verdicts(spark, str(tmp_path / "out")).select(*whole.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))
    totals = {r["pipeline"]: r["attempts"] for r in attempts.totals(spark, str(tmp_path / "out")).collect()}
    assert sum(totals.values()) == 120 and totals[None] == sum(r[1] is None for r in rows)


def test_a_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    """The state is written, then the query fails: the same batch is run again."""
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    log = spark.createDataFrame(attempt_rows(40), SCHEMA)
    real, fail = Versions.write, [False]

    def broken(self, df, batch):
        done = real(self, df, batch)
        if fail[0]:
            raise RuntimeError("lost after the state was written")
        return done

    monkeypatch.setattr(Versions, "write", broken)
    for part in range(2):
        log.where(F.col("seq") % 2 == part).withColumn("seq", F.col("seq") + 100 * part).write.mode("append").parquet(inbox)
        fail[0] = part == 1
        query = attempts.watch(spark.readStream.schema(SCHEMA).parquet(inbox), out, state)
        if fail[0]:
            with pytest.raises(Exception, match="lost after"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    fail[0] = False
    attempts.watch(spark.readStream.schema(SCHEMA).parquet(inbox), out, state).awaitTermination()
    assert attempts.verdicts(spark, out).count() == 40
    assert attempts.totals(spark, out).agg(F.sum("attempts")).first()[0] == 40
    assert attempts.verdicts(spark, out).agg(F.max("total_attempts")).first()[0] == 40


def test_windows_and_late_lines_hold_every_line(spark, tmp_path):
    draw = random.Random(1)
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    total = 0
    for batch in range(6):
        lines = []
        for _ in range(40):
            minute = max(0, batch * 90 - draw.choice([0, 5, 20, 200, 400]))
            lines.append(f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:30 - {draw.choice(['ERROR', 'WARN'])} - x{batch}")
        lines.append("no stamp ERROR")
        total += 40
        (inbox / f"{batch}.log").write_text("\n".join(lines) + "\n")
        logs.watch_windows(logs.stream_lines(spark, str(inbox)), out, state, delay="1 hour").awaitTermination()
    closed, still, late = logs.closed_windows(spark, out), logs.open_windows(spark, out), logs.late_lines_of(spark, out)
    counted = [df.agg(F.coalesce(F.sum("line_count"), F.lit(0))).first()[0] for df in (closed, still)]
    assert sum(counted) + late.count() == total and late.count() > 0 and counted[0] > 0
    assert closed.groupBy("window_start", "level").count().where("count > 1").count() == 0
    whole = logs.level_windows(logs.stream_lines(spark, str(inbox)))  # the same lines without closing
    assert whole.isStreaming
    assert {r["message"][-2:] for r in late.collect()} <= {f"x{i}" for i in range(1, 6)}


def test_missing_state_is_an_error(spark, tmp_path):
    state = Versions(spark, str(tmp_path), "n long")
    assert state.before(0).count() == 0 and state.last().count() == 0
    with pytest.raises(RuntimeError, match="not whole"):
        state.before(3)
    for i in range(4):
        state.write(spark.range(i).selectExpr("id AS n"), i)
    assert state.last().count() == 3 and state.before(3).count() == 2
