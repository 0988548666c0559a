"""Lines of pages against the SQL, over odd pages: none, empty, short, wide characters."""

import duckdb
from tidemark.plans import registry

HTML = [None, "", "ab", "é北🎉é <p>\r\n\tx</p>", "0123456789" * 8]


def rows_of(spark, folder, first):
    """Rows by Spark and by SQL over pages with ids from `first` on."""
    spark.createDataFrame([(first + k, "u", h) for k, h in enumerate(HTML)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = sorted(map(tuple, registry.queries()["clustered_lines"](spark, str(folder)).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return got, sorted(con.execute(registry.oracle_sql()["clustered_lines"]).fetchall())


def test_odd_pages_are_the_sql(spark, tmp_path):
    got, wanted = rows_of(spark, tmp_path, 0)
    assert got == wanted and any(text is None for *_, text in got)


def test_pages_beyond_the_sqls_limit_are_read(spark, tmp_path):
    low, (high, sql) = rows_of(spark, tmp_path / "low", 0)[0], rows_of(spark, tmp_path / "high", 100_000)
    assert sql == [] and [(page - 100_000, *rest) for page, *rest in high] == low
