"""Live log monitoring with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepact.operators.logs import parse_lines
from tablepact.streaming.versions import Versions, each_batch


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).withColumnRenamed("value", "line")


def level_windows(lines: DataFrame, width: str = "10 minutes", delay: str | None = None,
                  column: str = "line") -> DataFrame:
    """Errors and warnings per window and level.

    Without ``delay`` every line counts, however late, and all windows are kept:
    the form for history.  With it, the state of older windows is let go and
    lines that come later are left out; ``late_lines`` tells how many.  Lines
    without a stamp are removed before the watermark, so they cannot move it.
    """
    parsed = parse_lines(lines, column).filter(F.col("level").isNotNull())
    if delay is not None:
        parsed = parsed.withWatermark("event_time", delay)
    return (parsed.groupBy(F.window("event_time", width), "level")
            .agg(F.count(F.lit(1)).alias("line_count"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "level", "line_count"))


def error_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The stateless form: each error or warning line as it arrives."""
    return parse_lines(lines, column).filter(F.col("level").isNotNull())


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop.

    Every micro-batch writes the windows it changed under its batch id, so a
    repeated batch overwrites itself and ``latest_windows`` gives the final counts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (windows.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


WINDOWS = "window_start timestamp, window_end timestamp, level string, line_count long"
CLOCK = "latest long"


def watch_windows(lines: DataFrame, path: str, checkpoint: str, width: str = "10 minutes", delay: str = "1 hour",
                  column: str = "line") -> StreamingQuery:
    """Errors and warnings per window and level, where windows close and late lines are kept.

    A window closes once a line has been met that is ``delay`` later than its end;
    its counts are then written for good.  Lines that come after that are late:
    they are written themselves, so that no line is lost or counted twice.  Only
    open windows are state, which is written with each batch: exact over restarts.
    ``closed_windows``, ``open_windows`` and ``late_lines_of`` read the result.
    """
    spark = lines.sparkSession
    state = Versions(spark, f"{path}/open", WINDOWS)
    clock = Versions(spark, f"{path}/clock", CLOCK)

    def work(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch, column).filter(F.col("level").isNotNull()).select(
            "*", F.window("event_time", width).alias("_window")).persist()
        before = clock.before(number).first()
        before = before["latest"] if before else None

        def passed(end, latest: int | None):
            if latest is None:
                return F.lit(False)
            return end <= F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {delay}")

        late = passed(F.col("_window.end"), before)
        parsed.where(late).select("event_time", "timestamp", "level", "message").write.mode("overwrite").parquet(
            f"{path}/late/batch={number}")
        counts = parsed.where(~late).groupBy(
            F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "level").agg(
            F.count(F.lit(1)).alias("line_count"))
        newest = parsed.agg(F.max(F.unix_micros("event_time"))).first()[0]
        now = max((t for t in (before, newest) if t is not None), default=None)
        clock.write(spark.createDataFrame([(now,)], CLOCK), number)
        merged = state.before(number).unionByName(counts).groupBy("window_start", "window_end", "level").agg(
            F.sum("line_count").alias("line_count"))
        closed = passed(F.col("window_end"), now)
        merged.where(closed).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        state.write(merged.where(~closed), number)
        parsed.unpersist()

    return each_batch(lines, work, checkpoint)


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(f"{path}/closed").drop("batch")


def open_windows(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, f"{path}/open", WINDOWS).last()


def late_lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The late lines themselves."""
    return spark.read.schema("event_time timestamp, timestamp string, level string, message string").parquet(f"{path}/late").drop("batch")


def late_lines(query: StreamingQuery) -> int:
    """Groups of lines left out as too late, over the batches the query remembers (a hundred, by default).

    ``watch_windows`` keeps the lines themselves, of all batches.
    """
    return sum(int(state.numRowsDroppedByWatermark)
               for progress in query.recentProgress for state in progress.stateOperators)


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last written count of every window and level."""
    written = spark.read.parquet(path)
    return written.groupBy("window_start", "window_end", "level").agg(
        F.max_by("line_count", "batch").alias("line_count"))
