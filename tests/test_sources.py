"""Acquisition jobs on hand-written documents."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.sources import feeds, owned, pages as P, payloads, registry_files, sitemaps

NOW = "2024-03-10 00:00:00"

RSS = """<?xml version="1.0"?><rss><channel>
<item><title><![CDATA[Wave & <b>tide</b>]]></title><link>https://e.com/a</link><description>&lt;p&gt;x</description><content:encoded><![CDATA[<p>full</p>]]></content:encoded>
<pubDate>Sat, 09 Mar 2024 10:00:00 GMT</pubDate><dc:creator>Ann</dc:creator><media:content medium="image" url="https://e.com/i.png"/></item>
<item><title>Old</title><link>https://e.com/b</link><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>
<item><title>Undated <i>t</i></title><guid>g-1</guid></item><item><link>https://e.com/untitled</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry xml:lang="en"><title>Atom one</title><link rel="alternate" href="https://e.com/atom"/><content>body</content>
<updated>2024-03-08T00:00:00Z</updated><author><name>Bo</name></author><id>id-1</id></entry></feed>"""


def test_feeds(spark):
    raw = literal_table(spark, "source_id int, body string, http_ok boolean", [(1, RSS, True), (2, ATOM, None), (3, RSS, False), (4, "x" * 10, True)])
    raw = raw.withColumn("body", F.when(F.col("source_id") == 4, F.concat(F.lit(RSS), F.repeat(F.lit(" "), 1_000_001))).otherwise(F.col("body")))
    src = literal_table(spark, "id int, name string, domain string, rss_url string, language string, country_code string, fetch_priority int",
                        [(1, "Site", "e.com", "https://e.com/rss", "en", "SE", 90), (2, None, None, "https://www.f.com/atom", None, None, 30)])
    rows = {r.title: r for r in feeds.ingest_feeds(raw, src, NOW).collect()}
    assert set(rows) == {"Wave & <b>tide</b>", "Undated t", "Atom one"}
    one = rows["Wave & <b>tide</b>"]
    assert (one.url, one.content, one.author, one.image_url, one.published_at) == ("https://e.com/a", "<p>full</p>", "Ann", "https://e.com/i.png", datetime(2024, 3, 9, 10))
    assert rows["Undated t"].published_at is None and rows["Undated t"].url == ""
    atom = rows["Atom one"]
    assert (atom.url, atom.description, atom.author, atom.source_url, atom.published_at) == ("https://e.com/atom", "body", "Bo", "f.com", datetime(2024, 3, 8))
    kept = feeds.ingest_feeds(raw, src, NOW, strict_dates=False).filter("title = 'Undated t'").first()
    assert kept.published_at == datetime(2024, 3, 10)


def _sitemap(n, prefix):
    return "<urlset>" + "".join(f"<url><loc>https://d.com/{prefix}-{i:03d}</loc></url>" for i in range(n)) + "</urlset>"


@pytest.mark.parametrize("keep,children,first,last,total", [("last", {"c", "d", "e"}, "c-010", "e-059", 100), ("first", {"a"}, "a-000", "a-019", 20)])
def test_sitemap_caps(spark, keep, children, first, last, total):
    names = "abcde"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://d.com/{n}.xml</loc></sitemap>" for n in names) + "</sitemapindex>"
    raw = literal_table(spark, "domain string, url string, body string", [("d.com", "https://d.com/index.xml", index)] + [("d.com", f"https://d.com/{n}.xml", _sitemap(60, n)) for n in names])
    dom = literal_table(spark, "domain string, priority int", [("d.com", 50)])
    assert sitemaps.ingest_sitemaps(raw, dom, NOW, keep=keep).count() == 300
    caps = sitemaps.CAPS_LAST if keep == "last" else sitemaps.CAPS_FIRST
    urls = sorted(r.url for r in sitemaps.ingest_sitemaps(raw, dom, NOW, keep=keep, caps=caps).collect())
    assert len(urls) == total and urls[0] == f"https://d.com/{first}"
    assert {u.split("/")[-1][0] for u in urls} <= children


def test_sitemap_fields(spark):
    body = "<urlset><url><loc>https://d.com/2024/03/05/big-wave.html</loc></url><url><loc>https://d.com/x</loc><news:title><![CDATA[N &amp; T]]></news:title><news:publication_date>2024-03-01</news:publication_date></url><url><lastmod>2024</lastmod></url></urlset>"
    raw = literal_table(spark, "domain string, url string, body string", [("www.d.com", "u", body)])
    rows = [(r.title, r.published_at, r.source_domain) for r in sitemaps.sitemap_items(raw, NOW).orderBy("entry").collect()]
    assert rows == [("big wave", datetime(2024, 3, 5, 12), "d.com"), ("N & T", datetime(2024, 3, 1), "d.com")]


HTML = """<html lang="EN-gb"><head><meta property="og:site_name" content="Site"><link rel="canonical" href="/relative"><meta property="og:url" content="https://c.com/p/?ref=1">
<meta itemprop="datePublished" content="bad"><script>{"datePublished": "2024-03-02T00:00:00Z"}</script></head><body><header>H</header><nav>N</nav><aside>A</aside>
<p>Wave&nbsp;<b>power</b></p><script>x<1</script><footer>F</footer></body></html>"""


def test_extract_pages(spark):
    raw = literal_table(spark, "url string, html string", [("https://w.com/a", HTML), ("https://w.com/2024/3/5/b", "<p>plain</p><time datetime='2024-03-01'>")])
    one, two = P.extract_pages(raw, NOW).orderBy(F.col("url").desc()).collect()
    assert (one.lang, one.site_name, one.body_text, one.published_at) == ("en", "Site", "Wave power", datetime(2024, 3, 2))
    assert one.canonical_url == "https://w.com/a"
    assert (two.published_at, two.body_text, two.lang, two.canonical_url) == (datetime(2024, 3, 1), "plain", None, "https://w.com/2024/3/5/b")


def test_attributes_in_any_order(spark):
    html = """<HTML data-lang='xx' lang='pt'><meta content="2024-01-09" name='parsely-pub-date'><link href="https://c.com/x/" hreflang="de" rel='canonical'>
<meta content='It is "ours"' property="og:site_name"></HTML><nav class=a>n</nav ><navigation>kept</navigation><NAV>n</nav>"""
    raw = literal_table(spark, "url string, html string", [("https://w.com/a", html), ("https://w.com/b", ""), ("https://w.com/c", None)])
    one, two, three = P.extract_pages(raw, NOW).orderBy("url").collect()
    assert (one.lang, one.site_name, one.published_at, one.canonical_url, one.body_text) == ("pt", 'It is "ours"', datetime(2024, 1, 9), "https://c.com/x", "kept")
    assert (two.lang, two.site_name, two.published_at, two.body_text) == (None, None, None, "") and three.canonical_url == "https://w.com/c"


def test_listing_links(spark):
    html = "".join(f'<a class="x" href="{u}">{t}</a>' for u, t in [
        ("https://www.w.com/2024/03/x?utm_source=a", "A long enough title"), ("https://other.com/2024/03/x", "A long enough title"), ("https://w.com/short", "A long enough title"),
        ("https://w.com/one-two-three-four", "tiny"), ("https://w.com/item-123456", "Another <b>long</b> title"), ("https://w.com/one-two_three-four", "Yet another long title")])
    raw = literal_table(spark, "url string, html string", [("https://w.com/", html)])
    assert [r.url for r in P.harvest_links(raw, NOW).orderBy("position").collect()] == ["https://www.w.com/2024/03/x", "https://w.com/item-123456", "https://w.com/one-two_three-four"]
    assert P.harvest_links(raw, NOW, cap=1).count() == 1


def test_classification(spark):
    docs = [("https://a.com/f", RSS), ("https://b.com/f", ATOM), ("https://c.com/news.xml", "<?xml?>" + _sitemap(7, "s")), ("https://c.com/map.xml", _sitemap(2, "s")),
            ("https://d.com/p/x", '<html><link rel="alternate" type="application/atom+xml" href="/feed"></html>'), ("https://e.com/q", "<html><h2><a href='/x'>A heading of some length</a></h2></html>")]
    rows = {r.url: (r.source_type, r.feed_url, len(r.preview)) for r in P.classify_documents(literal_table(spark, "url string, body string", docs)).collect()}
    assert rows == {
        "https://a.com/f": ("rss", "https://a.com/f", 3), "https://b.com/f": ("atom", "https://b.com/f", 1), "https://c.com/news.xml": ("news_sitemap", "https://c.com/news.xml", 5),
        "https://c.com/map.xml": ("sitemap", "https://c.com/map.xml", 2), "https://d.com/p/x": ("rss", "https://d.com/feed", 0), "https://e.com/q": ("html", "https://e.com", 1)}


def test_blog(spark):
    raw = literal_table(spark, "url string, content string", [
        ("https://o.com/blog/big-news", "# T\n\n![img](x)\nFirst para about Portugal.\nSecond funding line.\nThird"), ("https://o.com/2024/02/x", "text"), ("https://o.com/about", "text"), ("https://o.com/2024/02/09/y", "")])
    rows = {r.url: r for r in P.import_blog(raw).collect()}
    assert set(rows) == {"https://o.com/blog/big-news", "https://o.com/2024/02/x"}
    assert rows["https://o.com/blog/big-news"].description == "First para about Portugal. Second funding line."
    assert rows["https://o.com/blog/big-news"].key_themes == ["funding", "Portugal"] and rows["https://o.com/2024/02/x"].published_at == datetime(2024, 2, 1)


def test_owned_files(spark, tmp_path):
    (tmp_path / "posts.csv").write_text('Exported from Page, all metrics\n\nPost title,Post link,Posted on,Impressions,Clicks,Reposts,Likes,Comments\n'
                                        '"Big, ""new"" wave",https://l/1,2024-03-01,"1,5",2,3,4,5\nNo date,https://l/2,,1,1,1,1,1\n,,2024-03-02,1,1,1,1,1\n,https://l/3,3/4/2024,,,,,\n')
    (tmp_path / "daily.csv").write_text("Date,Impressions (total),Impressions (organic),Clicks (total),Reactions (total),Comments (total),Reposts (total)\r\n2024-03-05,10,9,2,3,4,5\r\n")
    rows = {r.url: r for r in owned.import_owned_csv(spark, [str(tmp_path / "posts.csv"), str(tmp_path / "daily.csv")]).collect()}
    assert set(rows) == {"https://l/1", "https://l/3", "linkedin-daily-2024-03-05"}
    one, day = rows["https://l/1"], rows["linkedin-daily-2024-03-05"]
    assert (one.title, one.impressions, one.clicks, one.shares, one.engagement_score, one.comment_count) == ('Big, "new" wave', 1, 2, 3, 4, 5)
    assert rows["https://l/3"].title == "LinkedIn Post" and rows["https://l/3"].published_at == datetime(2024, 3, 4)
    assert (day.impressions, day.clicks, day.engagement_score, day.comment_count, day.shares) == (10, 2, 3, 4, 5)


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Name,Domain,active\n"Comma, Inc",c.com,false\n,d.com,\n"Known",k.com,true\n')
    (tmp_path / "r.json").write_text('[{"name": "J", "domain": "j.com", "country_code": "SE", "active": true}]')
    known = literal_table(spark, "domain string", [("k.com",)])
    rows = registry_files.read_registry(spark, str(tmp_path / "r.csv")).unionByName(registry_files.read_registry(spark, str(tmp_path / "r.json")))
    out = {r.domain: (r.name, r.country_code, r.region, r.active, r.approval_status) for r in registry_files.import_registry(rows, known).collect()}
    assert out == {"c.com": ("Comma, Inc", "US", "global", False, "pending"), "d.com": ("d.com", "US", "global", True, "pending"), "j.com": ("J", "SE", "global", True, "pending")}


def test_robots(spark):
    dom = literal_table(spark, "domain string, sitemap_url string", [("a.com", "https://a.com/own.xml"), ("b.com", None)])
    robots = literal_table(spark, "domain string, body string", [("a.com", "User-agent: *\r\nsitemap: https://a.com/sitemap.xml \nSitemap:https://a.com/own.xml")])
    out = {}
    for r in sitemaps.sitemap_locations(dom, robots).orderBy("domain", "position").collect():
        out.setdefault(r.domain, []).append(r.url.split(".com")[1])
    assert out == {"a.com": ["/own.xml", "/sitemap.xml", "/news-sitemap.xml", "/sitemap_index.xml"], "b.com": ["/sitemap.xml", "/news-sitemap.xml", "/sitemap_index.xml"]}


def test_payload_edges(spark):
    one = lambda kind, text: payloads.normalize_payload(literal_table(spark, "payload string", [(text,)]), kind, NOW).collect()
    assert one("newsapi", '{"articles": [{"title": "[Removed]", "url": "u"}, {"title": "", "url": "u"}]}') == []
    assert one("perigon", '{"articles": [{"title": "t", "url": "https://e.com"}]}') == []
    (g,) = one("gdelt", '{"articles": [{"title": "t", "url": "https://www.e.com/x", "seendate": "2024"}]}')
    assert (g.source_name, g.source_domain, g.published_at, g.language) == ("Unknown", "e.com", datetime(2024, 3, 10), "en")
    (r,) = one("reddit", '{"data": {"children": [{"data": {"title": "t", "permalink": "/p", "subreddit": "s", "created_utc": 0, "thumbnail": "self"}}]}}')
    assert (r.description, r.image_url, r.engagement_score, r.comment_count) == (None, None, 0, 0)
    (w,) = one("web_search", '{"data": [{"url": "https://e.com/2024/03/05/?utm_term=x", "title": "t"}, {"url": "https://x.com/a"}, {"url": ""}]}')
    assert (w.url, w.published_at) == ("https://e.com/2024/03/05", datetime(2024, 3, 5, 12))
    assert one("youtube", "not json") == []
    parts = payloads.union_connectors({"gdelt": literal_table(spark, "a int", [(1,)]), "rss": literal_table(spark, "b int", [(2,)])})
    assert sorted((r.connector, r.connector_rank) for r in parts.collect()) == [("gdelt", 1), ("rss", 0)]
