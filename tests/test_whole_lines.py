"""Lines of pages over whole texts: long and wide ones against the SQL, pages of one id against a plain version."""

import duckdb
from tidemark.plans import registry


def lines(spark, folder, pages):
    spark.createDataFrame([(k, "u", h) for k, h in pages], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return sorted(map(tuple, registry.queries()["clustered_lines"](spark, str(folder)).collect()))


def test_whole_texts_are_the_sql(spark, tmp_path):
    texts = ["".join(chr(97 + (k * k + n) % 26) for k in range(n)) for n in (59, 60, 61, 122, 123, 124, 246, 247)] + ["é北🎉\n" * 500, None, "", "x" * 60 + "\0" + "y" * 5000]
    got = lines(spark, tmp_path, list(enumerate(texts)))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["clustered_lines"]).fetchall())
    for k, text in enumerate(texts):
        mine = [(chars, t) for page, _, chars, t in got if page == k]
        assert sum(chars for chars, _ in mine) == max(60, len(text or ""))
        assert sorted("".join(t or "" for _, t in mine)) == sorted(text or "")


def test_pages_of_one_id_share_lines(spark, tmp_path):
    pages = [(7, "b" * 200), (7, "a" * 100), (7, None), (7, ""), (8, None), (8, None), (9, None), (9, "")]
    got = lines(spark, tmp_path, pages)
    wanted = {}
    for page, text in pages:
        for pos in range(1, max(60, len(text or "")) + 1):
            wanted.setdefault((page, int((pos * 7 % 41 + pos % 3 * 0.4) / 3.2 + 0.5)), []).append((pos, None if text is None else text[pos - 1 : pos]))
    plain = []
    for (page, line), chars in wanted.items():
        there = [(pos, c) for pos, c in chars if c is not None]
        plain.append((page, line, len(chars), "".join(c for _, c in sorted(there)) if there else None))
    assert got == sorted(plain)
