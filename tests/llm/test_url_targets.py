"""op4: relative targets and several links of a page."""
from volforge.llm import url_filters

# of each page of http://x.net: its path, its html, and where its links lead
CASES = [
    ("/a/b", '<link rel="canonical" href="c.html">', {"http://x.net/a/c.html"}),
    ("/a/b/", "<link href='../c?p=../q#r' rel=canonical>", {"http://x.net/a/c?p=../q#r"}),
    ("/a/b/d", '<link rel="canonical" href="./../../../c/./e/..">', {"http://x.net/c/"}),
    ("/a/b?q=1", '<link rel="canonical" href="?p=2">', {"http://x.net/a/b?p=2"}),
    ("", '<link rel="canonical" href="c">', {"http://x.net/c"}),
    ("/a", '<link rel="canonical" href="/r?u=http://y.org/z">', {"http://x.net/r?u=http://y.org/z"}),
    ("/a", '<link rel="alternate canonical" href="/1"><LINK REL=canonical HREF=/2><link rel="canonical" href="//y.org/3">',
     {"http://x.net/1", "http://x.net/2", "http://y.org/3"}),
    ("/a/", '<meta http-equiv="refresh" content="0; url=b"><meta http-equiv=refresh content="1;URL=\'c\'">', {"http://x.net/a/b", "http://x.net/a/c"}),
    ("/a", '<link rel="canonical" href="#top"><link rel="canonical" href="mailto:a@b.org"><link rel="stylesheet" href="/s">', set()),
    ("/a", '<link rel="noncanonical" href="/s">', set())]


def test_targets_are_resolved(spark):
    pages = spark.createDataFrame([(f"http://x.net{path}", f"{html}<p>{i}") for i, (path, html, _) in enumerate(CASES)], "url string, html string")
    for i, (path, html, want) in enumerate(CASES):
        found = url_filters.page_links(pages.where(pages.html == f"{html}<p>{i}")).collect()
        assert {r.to_url for r in found} == want, (path, html)
    lone = spark.createDataFrame([("no scheme/a", '<link rel="canonical" href="b">')], "url string, html string")
    assert url_filters.page_links(lone).count() == 0


def test_a_block_spreads_over_relative_and_later_links(spark):
    pages = spark.createDataFrame([
        (1, "http://good.org/a/1", '<link rel="canonical" href="2">'), (2, "http://good.org/a/2", None),
        (3, "http://good.org/b/", '<link rel="canonical" href="http://good.org/b/x"><link rel="canonical" href="../a/2">'),
        (4, "http://good.org/a/3", '<meta http-equiv="refresh" content="0; url=1"><meta http-equiv="refresh" content="0; url=http://x.net/fr/1">'),
        (5, "http://good.org/c", None)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
