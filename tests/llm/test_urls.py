"""URL lists: hosts of very many labels, and very long URLs, as in SQL."""

import duckdb

from wardline.llm import queries


def test_long_urls_as_sql(spark, tmp_path):
    labels = ".".join("abcdefghijklmnopqrst")
    rows = [(k, f"http://{labels}.{d}.example/p{k % 3}/{'x' * 50_000 if k == 4 else ''}") for k, d in enumerate(["one", "two", "one", "one", "two", "three"])]
    rows += [(10, "http://one.example/" + "y" * 100_000), (11, None), (12, ""), (13, "http://"), (14, "http://./"), (15, "http://a..b/")]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.OP10_SQL)
    names = [x[0] for x in found.description]
    got = queries.op10_url_lists(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
    assert len(got) == len(rows) and any(r.entry and r.entry.count(".") == 1 for r in got)


def test_columns_of_any_name_are_kept(spark):
    """Columns that are called as the steps call theirs come back as they were."""
    from wardline.llm import near_dup, url_lists

    pages = spark.createDataFrame([(1, "http://a.example/x", "k", "r", "t"), (2, None, "l", "s", None)], "page_id long, url string, keys string, _ROW string, _time string")
    got = url_lists.judge(pages.join(url_lists.fetched(pages).drop("url"), "page_id"), url_lists.derived_events(pages))
    assert sorted((r["page_id"], r["keys"], r["_ROW"], r["_time"]) for r in got.collect()) == [(1, "k", "r", "t"), (2, "l", "s", None)]
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (1, "other", 6, "y"), (2, "a b c d e f", 7, "z"), (None, None, 8, "n")], "doc_id long, text string, _own int, _Kept string")
    kept = near_dup.keep_texts(docs)
    assert kept.columns == docs.columns and sorted((r["_own"], r["_Kept"]) for r in kept.collect()) in ([(5, "x"), (6, "y"), (8, "n")], [(6, "y"), (7, "z"), (8, "n")])
