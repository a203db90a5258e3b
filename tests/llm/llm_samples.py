"""Small tables with every kind of odd row, and the given ones as plain rows."""

import os

import pyarrow.parquet as pq


def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def whole_table(name: str, order: str) -> list[dict]:
    return sorted(pq.read_table(f"{sf_dir()}/{name}.parquet").to_pylist(), key=lambda r: r[order])


_PROSE = ("The grey harbour slept under rain while gulls argued about bread, and nobody on the long "
          "pier cared who won. A clerk counted boats twice. ")
_LONG = " ".join(f"word{i % 977} of{i}" for i in range(6000)) + " ende."

#: doc_id, text, score (a clashing extra column), kept (another)
ODD_ROWS = [
    (1, _PROSE * 3, 5, "x"), (2, None, None, None), (3, "", 1, "y"), (None, "no id here", 2, None),
    (None, _PROSE, 2, None), (5, " \n\t ", 3, "z"), (6, _PROSE * 3, 3, "z"), (6, _PROSE * 3, 3, "z"),
    (7, _LONG, 4, "q"), (8, "ab" * 3000, 4, "q"), (9, "same ties", 1, "a"), (9, "other text, same id", 1, "a"),
    (10, "é ü ☃   x\x1cy", 0, ""),
]


def odd_documents(spark):
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string, score int, kept string")
