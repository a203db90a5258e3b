"""Versioned tables for stores where a rename is a copy.

Every load writes its rows to a folder of its own and then claims the next
version by creating its manifest, a small file that must not exist yet.  Creating
it is the whole commit: readers take the highest manifest, so they see the old
version or the new one and never parts of either.  Of two loads that claim the
same version one fails, and the folders of failed loads are never referred to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablepact.sources.sinks import counted_write, drop_folder

MANIFESTS, DATA = "_manifests", "data"


class Conflict(Exception):
    """Another load has claimed the version this one was made for."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    rows: int


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, target: str) -> list[int]:
    folder, fs = _path(spark, f"{target.rstrip('/')}/{MANIFESTS}/v*.json")
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.globStatus(folder) or ())


def _manifest(target: str, number: int) -> str:
    return f"{target.rstrip('/')}/{MANIFESTS}/v{number:012d}.json"


def versions(spark: SparkSession, target: str) -> list[Version]:
    """All versions, the oldest first."""
    found = []
    for number in _numbers(spark, target):
        path, fs = _path(spark, _manifest(target, number))
        stream = fs.open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found.append(Version(number, **json.loads(text)))
    return found


def _claim(spark: SparkSession, target: str, version: Version) -> None:
    """Create the manifest; the one call that either makes the version or fails."""
    path, fs = _path(spark, _manifest(target, version.number))
    try:
        stream = fs.create(path, False)
    except Exception as exc:  # the store's own error for a file that exists
        if version.number in _numbers(spark, target):
            raise Conflict(f"Version {version.number} of {target} exists") from exc
        raise
    try:
        stream.write(bytearray(json.dumps({"folder": version.folder, "rows": version.rows}).encode()))
    finally:
        stream.close()


def publish(df: DataFrame, target: str, expected: int | None = None) -> Version:
    """Write a new version of the table: all rows or nothing.

    ``expected`` is the version the rows were made from (by default the newest when
    writing begins); if another load has published since, this one raises
    ``Conflict`` and its rows are dropped.  A load that fails leaves the readable
    version as it was.
    """
    spark = df.sparkSession
    before = expected if expected is not None else max(_numbers(spark, target), default=0)
    name = f"{DATA}/{uuid.uuid4().hex}"
    folder = f"{target.rstrip('/')}/{name}"
    try:
        version = Version(before + 1, name, counted_write(df, folder))
        _claim(spark, target, version)
    except Exception:
        drop_folder(spark, folder)
        raise
    return version


def read_published(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The newest version of the table, or a given one."""
    found = {v.number: v for v in versions(spark, target)}
    if not found or number is not None and number not in found:
        raise FileNotFoundError(f"No version {number or ''} of {target}")
    return spark.read.parquet(f"{target.rstrip('/')}/{found[number or max(found)].folder}")


def drop_versions(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Remove the data of all but the newest ``keep`` versions; their manifests stay, so numbers are not used again."""
    gone = versions(spark, target)[:-keep] if keep else []
    for version in gone:
        drop_folder(spark, f"{target.rstrip('/')}/{version.folder}")
    return [v.number for v in gone]
