"""Delimited files whose fields may hold line breaks, read block by block.

A line break inside quotes ends a line but no row, so where a row ends depends
on all that stands before it in the file.  What a stretch of lines does to the
question is a small function: it leaves the reader inside or outside quotes,
given that it entered inside or outside.  Each block's function is found on its
own, the functions of a file's blocks are combined in order, and then every
block is cut at its true row ends, knowing how it is entered.  Only the pieces
of rows that cross a block are brought together, one row at a time.

Where no line of a path ends inside quotes, the ordinary reader gives the same
rows and is used instead.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.functions.text import quoted
from tablepact.plans.ordered import checkpoint_dir

#: Blocks that begin inside quotes (16 bytes each) that are broadcast at most.
BROADCAST_BLOCKS = 100_000
#: Bytes that one task reads at least, where blocks are smaller and there are more of them than cores.
TASK_BYTES = 32 << 20
DELIMITER = ","

_BOM = "﻿"


def ends_inside(line: str, inside: bool, delimiter: str = DELIMITER) -> bool:
    """Whether a line that is entered inside (or outside) quotes leaves the reader inside them.

    A quote opens a field only as its first character, two of them inside quotes
    are one, and what follows the closing quote up to the delimiter is ignored.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        inside = True
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('""', at):
            at += 2
            continue
        inside = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _opens(line: Column, delimiter: str) -> Column:
    """The same for a line entered outside quotes, as an expression over its fields."""
    def quotes(piece: Column) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))

    def after(inside: Column, piece: Column) -> Column:
        odd = quotes(piece) % 2 == 1
        return F.when(inside, ~odd).otherwise(piece.startswith('"') & odd)

    pieces = F.split(line, f"\\Q{delimiter}\\E")
    return F.when(line.contains('"'), F.aggregate(pieces, F.lit(False), after)).otherwise(F.lit(False))


def tasks_for(spark: SparkSession, path) -> int:
    """How many tasks read the files; several blocks of a small size are one task's work, one after the other."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def _lines(spark: SparkSession, path, tasks: int) -> DataFrame:
    """Lines with their file (as a hash), block and place; a row's lines are broken at ``\\n`` only."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64(F.col("_metadata.file_path")).alias("file"),
                        F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).coalesce(tasks)


@dataclass(frozen=True)
class Survey:
    """The different headers below a path, the files of each, and whether rows hold line breaks.

    ``files`` is empty where all files share one header.  ``headers`` are in the order of the first file's name.
    Where rows hold line breaks, ``rows`` are those of :func:`rows_of`.
    """

    headers: list[tuple[str, ...]]
    files: dict[tuple[str, ...], list[str]]
    broken: bool
    rows: DataFrame | None = None


def survey(spark: SparkSession, path, delimiter: str = DELIMITER) -> Survey:
    """One pass over the lines, in tasks; a row per different header comes back.

    Empty files have no header.  The names of the files are gathered only where
    headers differ, and then as many as the reader itself has to be given.
    """
    per_file = written(_lines(spark, path, tasks_for(spark, path)).where(_filled("value")).groupBy("path").agg(
        F.min_by("value", F.struct("block", "place")).alias("header"),
        F.bool_or(_opens(F.col("value"), delimiter)).alias("broken"))
        .withColumn("header", F.rtrim(_without_mark("header"), F.lit("\r"))), "headers")
    found = per_file.groupBy("header").agg(F.bool_or("broken").alias("broken"), F.min("path").alias("first"))
    kinds = found.orderBy("first").collect()  # a row per header
    if any(r["broken"] for r in kinds):
        return _survey_rows(spark, path, delimiter)
    files: dict[tuple[str, ...], list[str]] = {}
    for kind in kinds:
        named = files.setdefault(parse_record(kind["header"], delimiter), [])
        if len(kinds) > 1:
            named += [r["path"] for r in per_file.where(F.col("header") == kind["header"]).select("path").collect()]
    return Survey(list(files), files if len(files) > 1 else {}, False)


def _filled(name: str) -> Column:
    """Rows that ordinary readers do not skip as blank."""
    return F.col(name).rlike("[^\\x00-\\x20]")


def _without_mark(name: str) -> Column:
    return F.ltrim(F.col(name), F.lit(_BOM))


def _survey_rows(spark: SparkSession, path, delimiter: str) -> Survey:
    """Headers where rows hold line breaks: the first row of each file, which may hold some itself."""
    rows = rows_of(spark, path, delimiter)
    first = rows.where("is_header").select("path", "row")
    kinds = first.groupBy(_without_mark("row").alias("header")).agg(F.min("path").alias("first"))
    headers: dict[tuple[str, ...], None] = {}
    for row in kinds.orderBy("first").collect():  # a row per header
        headers.setdefault(parse_record(row["header"], delimiter))
    return Survey(list(headers), {}, True, rows)


def parse_record(row: str, delimiter: str = DELIMITER) -> tuple[str, ...]:
    """The fields of one row, which may hold line breaks."""
    return tuple(next(csv.reader(io.StringIO(row, newline=""), delimiter=delimiter)))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch that lie in one block of one file."""
    file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    start = 0
    for at in range(1, batch.num_rows + 1):
        if at == batch.num_rows or file[at] != file[start] or block[at] != block[start]:
            yield batch.slice(start, at - start)
            start = at


def _has_quotes(batch: pa.RecordBatch) -> bool:
    return bool(pc.any(pc.match_substring(batch.column("value"), '"')).as_py())


_ENDS = "file long, block long, path string, from_outside boolean, from_inside boolean"


def block_functions(lines: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """For each block, whether it leaves the reader inside quotes, entered outside and inside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, ends = None, None, (False, True)
        done = []

        def close():
            done.append((*now, path, *ends))

        for batch in batches:
            for part in _runs(batch) if batch.num_rows else ():
                key = (part.column("file")[0].as_py(), part.column("block")[0].as_py())
                if key != now:
                    if now is not None:
                        close()
                    now, path, ends = key, part.column("path")[0].as_py(), (False, True)
                if _has_quotes(part):
                    outside, inside = ends
                    for line in part.column("value").to_pylist():
                        if '"' in line:
                            outside, inside = ends_inside(line, outside, delimiter), ends_inside(line, inside, delimiter)
                    ends = outside, inside
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(
                [c.split()[0] for c in _ENDS.split(", ")], map(list, zip(*done, strict=True)), strict=True)))

    return lines.select("file", "block", "path", "value").mapInArrow(run, _ENDS)


_ENTRIES = "file long, block long, inside boolean"


def entries(functions: DataFrame) -> DataFrame:
    """How each block is entered: the functions of the blocks before it, applied in the order of the file.

    One row per block is gathered by file; a file of 100 TB has a million of them.
    """
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("inside", pa.bool_())])

    def run(blocks: pa.Table) -> pa.Table:
        inside, out = False, []
        for b in sorted(blocks.to_pylist(), key=lambda b: b["block"]):
            out.append({"file": b["file"], "block": b["block"], "inside": inside})
            inside = b["from_inside"] if inside else b["from_outside"]
        return pa.Table.from_pylist(out, schema=schema)

    return functions.select("file", "block", "from_outside", "from_inside").groupBy("file").applyInArrow(run, _ENTRIES)


#: Pieces of rows: whole ones, the end and the beginning of a row that crosses a block, and a block inside one.
WHOLE, END, BEGIN, MIDDLE = range(4)
_PIECES = "file long, block long, piece long, kind int, row string"


def pieces_of(lines: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """Each block, whose lines carry how it is entered (``inside``), cut at its row ends."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, begun_before, piece, held = None, False, False, 0, []

        def out(rows, of):
            file, block = now
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, kinds[0]), pa.array([block] * n, kinds[1]),
                 pa.array(range(piece, piece + n), kinds[2]), pa.array(of, kinds[3]), pa.array(rows, kinds[4])], names)

        def close():
            """What is left of a block: a row that goes on in the next one."""
            return out(["\n".join(held)], [MIDDLE if begun_before else BEGIN])

        for batch in batches:
            for part in _runs(batch) if batch.num_rows else ():
                key = (part.column("file")[0].as_py(), part.column("block")[0].as_py())
                if key != now:
                    if held:
                        yield close()
                    now, inside, piece, held = key, part.column("inside")[0].as_py(), 0, []
                    begun_before = inside
                values = part.column("value")
                if not inside and not _has_quotes(part):
                    yield out(values.cast(pa.string()), [WHOLE] * len(values))
                    piece += len(values)
                    continue
                rows, of = [], []
                for line in values.to_pylist():
                    inside = ends_inside(line, inside, delimiter)
                    held.append(line)
                    if not inside:
                        rows.append("\n".join(held))
                        of.append(END if begun_before else WHOLE)
                        held, begun_before = [], False
                if rows:
                    yield out(rows, of)
                    piece += len(rows)
        if held:
            yield close()

    return lines.select("file", "block", "value", "inside").mapInArrow(run, _PIECES)


def rows_of(spark: SparkSession, path, delimiter: str = DELIMITER) -> DataFrame:
    """``path, file, block, piece, row, is_header``: the rows of delimited files, each as one text.

    Rows are in the order of ``(block, piece)`` in each file.  Blank rows are left
    out, as ordinary readers do.  Lines are broken at ``\\n`` or ``\\r\\n``; inside
    quotes both stay as they are.  A last row whose quotes are never closed ends
    with its file.  Empty files give no rows.
    """
    tasks = tasks_for(spark, path)
    lines = _lines(spark, path, tasks)
    functions = written(block_functions(lines, delimiter), "blocks")
    # Few blocks begin inside quotes; of the others nothing has to be known.
    inside = written(entries(functions).where("inside"), "entered")
    marks = inside.select("file", "block", "inside")
    if inside.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        marks = F.broadcast(marks)
    # The join keeps the order of the lines, which a broadcast one does.
    marked = lines.select("file", "block", "value", "place").join(marks, ["file", "block"], "left").withColumn(
        "inside", F.coalesce("inside", F.lit(False)))
    if marks is inside:
        marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    pieces = written(pieces_of(marked, delimiter), "pieces").coalesce(tasks)
    if pieces.join(functions, ["file", "block"], "left_anti").limit(1).count():
        raise RuntimeError("The files were split differently between two passes; set spark.sql.files.minPartitionNum")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "piece", "row")
    crossing = pieces.where(F.col("kind") != WHOLE)
    # Which row a piece belongs to is known without its text; then each row's pieces meet.
    before = Window.partitionBy("file").orderBy("block", "piece")
    named = crossing.select("file", "block", "piece", F.count_if(F.col("kind") == BEGIN).over(before).alias("of"))
    parts = F.sort_array(F.collect_list(F.struct("block", "piece", "row")))
    stitched = (crossing.join(named, ["file", "block", "piece"]).groupBy("file", "of").agg(parts.alias("parts"))
                .select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["piece"].alias("piece"),
                        F.array_join(F.col("parts")["row"], "\n").alias("row")))
    rows = whole.unionByName(stitched).where(_filled("row"))
    rows = rows.withColumn("row", F.when(F.col("row").endswith("\r"), F.expr("left(row, length(row) - 1)"))
                           .otherwise(F.col("row")))
    firsts = rows.groupBy("file").agg(F.min(F.struct("block", "piece")).alias("first"))
    paths = functions.groupBy("file").agg(F.min("path").alias("path"))
    per_file = paths.join(firsts, "file")  # one row per file
    return rows.join(per_file, "file").select(
        "path", "file", "block", "piece", "row", (F.struct("block", "piece") == F.col("first")).alias("is_header"))


def fields_of(rows: DataFrame, headers: Sequence[tuple[str, ...]], names: Sequence[str],
              delimiter: str = DELIMITER) -> DataFrame:
    """The fields of all rows as text, bound by the header of their own file."""
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}

    def fields(header: Sequence[str]) -> Column:
        parsed = F.from_csv("row", _ddl(header), options)
        # Bound to a variable, so that a row is parsed once, not once for each field.
        return F.transform(F.array(parsed), lambda row: F.struct(*[row[n].alias(n) for n in names]))[0]

    body = rows.where(~F.col("is_header"))
    if len(headers) == 1:
        return body.select(fields(headers[0]).alias("r")).select("r.*")
    heads = rows.where("is_header").select("file", _without_mark("row").alias("head"))
    chosen = F.when(F.lit(False), fields(names))
    for row in heads.select("head").distinct().collect():  # a row per header
        chosen = chosen.when(F.col("head") == row["head"], fields(parse_record(row["head"], delimiter)))
    return body.join(heads, "file").select(chosen.alias("r")).select("r.*")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"{quoted(n)} STRING" for n in names)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage, so that later passes see the same blocks: write to the shared folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tablepact-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
