"""The guard of ad-hoc SQL walks the plan, not the text."""

import pytest

from tablepact.catalogue.robust import REFUSED_QUERIES
from tablepact.sources import catalog


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("guard"))
    nation = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(9)], "n_nationkey long, n_name string, n_regionkey long")
    nation.write.parquet(f"{folder}/nation.parquet")
    spark.read.parquet(f"{folder}/nation.parquet").createOrReplaceTempView("guarded_nation")
    spark.sql("SELECT java_method('java.lang.Math', 'abs', -7) AS x").createOrReplaceTempView("guarded_view")
    spark.udf.register("guarded_function", lambda x: x, "string")
    nation.mapInArrow(lambda batches: batches, nation.schema).createOrReplaceTempView("guarded_prepared")
    return spark, folder


ALLOWED = [
    "SELECT 'reflect(x) java_method(1)' AS text FROM guarded_nation",
    "WITH t AS (SELECT n_regionkey, count(*) AS n FROM guarded_nation GROUP BY n_regionkey) SELECT * FROM t JOIN t AS u USING (n_regionkey)",
    "SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM guarded_nation",
    "SELECT n_name FROM guarded_nation WHERE EXISTS (SELECT 1 FROM guarded_prepared p WHERE p.n_nationkey = guarded_nation.n_nationkey)",
    "SELECT * FROM range(5) UNION ALL SELECT n_nationkey FROM guarded_nation",
    "SELECT explode(array(1, 2)) AS x, url_decode('a%20b') AS u, parse_json('{}') AS j, to_json(struct(n_name)) AS s FROM guarded_nation",
    "SELECT * FROM VALUES (1), (2) AS t(x) ORDER BY x LIMIT 1", "SELECT transform(array(1, 2), x -> x + 1) AS t, n_name LIKE 'n%' AS l FROM guarded_nation",
    "SELECT * FROM guarded_nation PIVOT (count(n_name) FOR n_regionkey IN (0, 1))",
    "SELECT percentile_approx(n_nationkey, 0.5) AS p, collect_set(n_name) AS c FROM guarded_nation", "SHOW TABLES",
    "DESCRIBE guarded_nation", "EXPLAIN SELECT 1",
]


@pytest.mark.parametrize("query", ALLOWED)
def test_queries_run(session, query):
    spark, _ = session
    found = catalog.run_query(spark, query)
    assert found.error is None, found.error
    rows, error = found.execute()
    assert rows and error is None


@pytest.mark.parametrize("name", REFUSED_QUERIES)
def test_refused(session, name):
    spark, folder = session
    query = REFUSED_QUERIES[name]
    found = catalog.run_query(spark, query.format(sf_dir=folder) if name == "file" else query)
    assert found.error and found.frame is None


def test_a_query_is_run_once(session, monkeypatch):
    spark, _ = session
    found = catalog.run_query(spark, "SELECT n_nationkey FROM guarded_nation", 9)
    runs = []
    real = type(found.frame).collect
    monkeypatch.setattr(type(found.frame), "collect", lambda self: runs.append(1) or real(self))
    assert found.truncated is False and found.row_count() == 9 and len(found.execute()[0]) == 9 and len(runs) == 1
    cut = catalog.run_query(spark, "SELECT n_nationkey FROM guarded_nation", 4)
    assert cut.truncated and len(cut.execute()[0]) == 4 and cut.row_count() == 9
