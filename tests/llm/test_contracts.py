"""op4 with its SQL on pages with links, op5 with repeated ids, and result names that clash."""
import duckdb
import pytest
from pyspark.sql import functions as F

from volforge.llm import exact_topk, line_dedup, mixing, sentencepiece_fst, url_filters

PAGES = [
    (1, "http://good.org/view?id=1", '<link rel="canonical" href="http://x.net/fr/1">'),
    (2, "http://good.org/view?id=2", None),
    (3, "http://good.org/view?id=1#part", None),
    (4, "http://good.org/a/b/c", '<link href="../d?x=1" rel="next canonical"><link rel="canonical" href="e">'),
    (5, "http://good.org/a/d?x=1", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=/view?id=1">'),
    (6, "http://good.org/a/b/e", ""),
    (7, "http://shop.com/q", '<link rel=canonical href="http://good.org/a/b/e">'),
    (8, "http://www.example.com/de/", '<link rel="canonical" href="//x.net/es/z">'),
    (9, "http://good.org/dots", '<link rel="canonical" href="/p/./q/../r/..">'),
    (10, "http://good.org/p/", '<link rel="canonical" href="?n=1">'),
    (11, "http://good.org/p/?n=1", '<link rel="canonical" href="http://y.net/fr/">'),
    (12, "http://good.org", '<link rel="canonical" href="mailto:a@b"><link rel="noncanonical" href="http://x.net/fr/1">'),
    (13, None, '<link rel="canonical" href="http://x.net/fr/1">'), (14, "no scheme", '<link rel="canonical" href="/a">'), (14, "http://x.net/fr/1", None)]


def test_op4_and_its_sql_agree_where_pages_link(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    monkeypatch.setattr(url_filters, "table", lambda *_: pages)
    rows = url_filters.op4_url_filters(spark, "")
    got = sorted(map(tuple, rows.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert got == sorted(con.execute(url_filters.ORACLE["op4_url_filters"]).fetchall(), key=str)
    verdict = [(r[0], r[4]) for r in got]
    assert {i for i, v in verdict if v == "block"} == {1, 3, 4, 5, 6, 9, 10, 11, 14} and (2, "allow") in verdict and (7, "allow") in verdict


def test_other_rows_of_the_query_s_id_are_candidates(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, lambda i: i % 100 == 0, every_row=True, scale=1, k=3).collect()
    assert sorted((r.vec_id, r.score) for r in got) == [(1, 3), (1, 6), (2, 0), (2, 0), (100, 2), (100, 2)]


def test_a_column_of_the_result_s_name_is_replaced(spark, edge):
    coded = sentencepiece_fst.encode(edge, decoded_col="extra")
    assert coded.columns.count("ids") == 1 and coded.schema["ids"].dataType.simpleString() == "array<int>"
    assert sentencepiece_fst.decode(coded.withColumn("Decoded", F.lit(1)), out_col="decoded").where("decoded <> coalesce(text, '')").count() <= 1
    with pytest.raises(ValueError):
        sentencepiece_fst.encode(edge, ids_col="Text")
    for made, name in ((mixing.mix(edge, max_repeats=2.0), "copies"), (line_dedup.dedup_lines(edge), "lines")):
        assert [c.lower() for c in made.columns].count(name) == 1 and made.count() == edge.count()
    with pytest.raises(ValueError):
        url_filters.judge_urls(spark.createDataFrame([("a", "u", "h")], "host string, url string, html string"), id_col="host")
