"""State of a stream as versions of a table, one for each micro-batch.

Batch ``n`` reads version ``n - 1`` and writes version ``n``, and its results go to
folders named after the batch.  A batch that is repeated after a failure finds
the same version, and overwrites what it had begun to write: every row counts
once, over restarts as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablepact.sources.files import path_exists
from tablepact.sources.sinks import drop_folder


class Versions:
    """Versions of a state table below a folder; the last two are kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, batch: int) -> str:
        return f"{self.path}/version={batch}"

    def before(self, batch: int) -> DataFrame:
        """The state behind the batch before; empty before the first."""
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        if not path_exists(self.spark, f"{self._folder(batch - 1)}/_SUCCESS"):
            raise RuntimeError(f"The state before batch {batch} is not whole: {self._folder(batch - 1)}")
        return self.spark.read.schema(self.schema).parquet(self._folder(batch - 1))

    def write(self, state: DataFrame, batch: int) -> DataFrame:
        state.write.mode("overwrite").parquet(self._folder(batch))
        if batch > 1:
            drop_folder(self.spark, self._folder(batch - 2))
        return self.spark.read.schema(self.schema).parquet(self._folder(batch))

    def last(self) -> DataFrame:
        """The newest state."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root)
        names = [s.getPath().getParent().getName() for s in found or ()]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.before(1 + max(int(n.partition("=")[2]) for n in names))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``work`` on what there is, batch by batch, and stop."""
    return (stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
