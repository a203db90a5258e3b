"""Versions of a published table, and distinct values by digests."""

import pytest
from pyspark.sql import functions as F

from tablepact.operators import profile
from tablepact.sources import published


def test_readers_see_whole_versions_only(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, target)
    assert published.publish(spark.range(5), target).number == 1
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        published.publish(broken, target)
    assert published.read_published(spark, target).count() == 5
    second = published.publish(spark.range(7), target)
    assert (second.number, second.rows) == (2, 7)
    with pytest.raises(published.Conflict):
        published.publish(spark.range(9), target, expected=1)
    assert published.read_published(spark, target).count() == 7
    assert published.read_published(spark, target, 1).count() == 5
    data = [p for p in (tmp_path / "t" / "data").iterdir() if not p.name.startswith(".")]
    assert len(data) == 2  # of the failed loads nothing is left
    published.publish(spark.range(1), target)
    assert published.drop_versions(spark, target, 2) == [1] and published.read_published(spark, target).count() == 1
    assert [v.number for v in published.versions(spark, target)] == [1, 2, 3]


def test_a_load_that_comes_second(spark, tmp_path, monkeypatch):
    """Both begin at the same version; the one that claims it later fails."""
    target, real = str(tmp_path / "t"), published._claim

    def overtaken(session, path, version):
        monkeypatch.setattr(published, "_claim", real)
        published.publish(spark.range(3), target)
        real(session, path, version)

    monkeypatch.setattr(published, "_claim", overtaken)
    with pytest.raises(published.Conflict):
        published.publish(spark.range(8), target)
    assert published.read_published(spark, target).count() == 3


def test_distinct_values_by_digest(spark):
    df = spark.createDataFrame([(1, "a", 0.0, None), (1, None, -0.0, None), (2, "", float("nan"), None), (None, "a", float("nan"), None)],
                               "k int, t string, x double, n string")
    exact, digest = (profile.quality_report(df, distinct=d) for d in ("exact", "digest"))
    rows = {d: {r["column"]: r.asDict() for r in f.select(*exact.columns).collect()} for d, f in (("e", exact), ("d", digest))}
    assert rows["e"] == rows["d"] and rows["d"]["x"]["distinct_count"] == 2 and rows["d"]["n"]["distinct_count"] == 0
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(position") <= 2
    empty = profile.quality_report(df.limit(0), distinct="digest").collect()
    assert [r["distinct_count"] for r in empty] == [0, 0, 0, 0]
