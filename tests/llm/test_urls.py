from filamenta.llm import urls

PAGES = [
    (1, "https://www.example.com/en/a", "<html>"),
    (2, "https://Example.COM/en/b#x", None),
    (3, "http://a.org/x?q=1#top", '<link rel="canonical" href="http://shop.example.com/en/c">'),
    (4, "http://b.org/y", "<META HTTP-EQUIV=refresh content='0; URL=//a.org/x?q=1'>"),
    (5, "http://b.org/dir/z", "<link href='y' rel=canonical>"),
    (6, "http://c.com/dir/", "<link rel='canonical' href='http://a.org/x?q=1'>"),
    (7, None, "<link rel=canonical href='http://a.org/x?q=1'>"),
    (8, "no scheme", ""),
    (9, "http://d.net/fr/1", ""),
    (10, "http://d.net", '<link rel="canonical" href="/fr/1">'),
    (11, "http://e.net/de/", '<link rel="stylesheet" href="http://d.net/fr/1">'),
    (12, "http://b.org/y", ""),
    (None, "http://b.org/other/../y", "<p>"),
    (13, "http://com/", ""),
    (14, "http://b.org/dir/w", "<link rel=canonical href=y>"),
]


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert len(got) == len(PAGES)
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/b", "example.com/en/", "block")
    assert got[3] == ("a.org", "/x", None, "block")  # its canonical URL is blocked
    assert [got[i][3] for i in (4, 12)] == ["block", "block"]  # and so are its aliases, by URL
    assert got[5][3] == got[14][3] == "allow"  # b.org/dir/y is another page
    assert got[6] == ("c.com", "/dir/", "com/", "allow")  # explicit allow precedes
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("net/fr/", "block") and got[10] == ("d.net", "", None, "block") and got[11][3] == "allow"
    assert got[13] == ("com", "/", "com/", "allow")


def test_empty_and_without_links(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] in (1, 2, 9)], "page_id long, url string, html string")
    assert sorted(r.verdict for r in urls.judged(pages).collect()) == ["allow", "block", "block"]
    assert urls.judged(pages.limit(0)).count() == 0
