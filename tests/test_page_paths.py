"""Every page's own url is judged, by Spark and by the SQL alike."""

import duckdb

from corpusloom import queries as q

WANT = {
    "http://a.com/src/a.py": None, "http://a.com/Dist/bundle.js": "generated_or_dependency_path", "http://a.com/src/b.min.js": "minified_file",
    "http://a.com/src/b.MIN.js": None, "http://a.com/assets/logo.PNG?x=1": "unsupported_language", "http://a.com/x/y.tar#z": "unsupported_language",
    "http://a.com": None, "http://a.com?u=/b.png": None, "http://a.com/lib.so/readme": None, "no scheme.png": None, "": None, None: None,
    "http://a.com/vendor/logo.gif": "generated_or_dependency_path",
}


def test_page_paths(spark, tmp_path):
    rows = [(6 * i + k, u) for i, u in enumerate(WANT) for k in range(6)]  # each url with every page_id % 6
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.path, r.reason) for r in q.queries()["p01_page_skip_reason"](spark, str(tmp_path)).collect()}
    assert {i: reason for i, (_, reason) in got.items()} == {i: WANT[u] for i, u in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    sql = con.sql(q.oracle_sql()["p01_page_skip_reason"])
    assert {r[0]: r[1:] for r in sql.fetchall()} == got and sql.columns == ["page_id", "path", "reason"]
