from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mentionlake.functions import dates as D, scalars as S, text as X, urls as U

NOW = "2024-03-10 00:00:00"


@pytest.mark.parametrize("raw,out", [
    ("a &amp; b &#8217; &#x1F600; &lt;i&gt;", "a & b ’ 😀 <i>"),
    ("no entities", "no entities"),
    ("&#0; &#55296; stay", "&#0; &#55296; stay"),
    ("&AMP;&quot;&apos;&nbsp;.", "&\"' ."),
])
def test_decode_entities(value, raw, out):
    assert value(X.decode_entities, raw) == out


def test_strip_and_normalize(value):
    assert value(X.strip_markup, "<p>Énergie&nbsp;<b>bleue</b></p>\n x") == "Énergie bleue x"
    assert value(X.normalized, "Wave—Energy_2024 <i>Ñandú</i>!") == "wave energy 2024 ñandú"


@pytest.mark.parametrize("title,head,pub", [
    ("A - B - Reuters", "A - B", "Reuters"), (" - X", " - X", ""), ("no dash", "no dash", ""),
])
def test_split_publisher(value, title, head, pub):
    assert value(lambda c: X.split_publisher(c)[0], title) == head
    assert value(lambda c: X.split_publisher(c)[1], title) == pub


def test_title_words(value):
    assert value(X.title_words, "The Wave, wave POWER plan! éolien") == ["wave", "power", "plan", "olien"]
    assert value(X.title_words, "海洋能源") == []


@pytest.mark.parametrize("url,out", [
    ("https://Ex.com/a/?utm_source=x&b=1#top", "https://ex.com/a?b=1"),
    ("https://ex.com//?ref=1", "https://ex.com/"),
    ("https://ex.com/", "https://ex.com/"),
    ("https://ex.com", "https://ex.com/"),
    ("https://ex.com/a///", "https://ex.com/a"),
    ("not a url", "not a url"),
])
def test_canonical_url(value, url, out):
    assert value(U.canonical_url, url) == out


def test_domains(value):
    assert value(U.normalize_domain, "https://WWW.Ex.com/a/b") == "ex.com"
    assert value(U.domain_of, "https://www.news.ex.co.uk:8080/x") == "news.ex.co.uk"
    assert value(U.domain_of, "nothing") is None
    assert value(lambda c: U.on_host_list(c, ["bbc.co.uk"]), "news.bbc.co.uk") is True
    assert value(lambda c: U.on_host_list(c, ["ft.com"]), "microsoft.com") is False
    assert value(lambda c: U.contains_any(c, ["ft.com"]), "microsoft.com") is True


def test_slug_and_hash(value):
    assert value(U.title_from_slug, "https://e.com/x/big-wave_energy%20news.html") == "big wave energy news"

    def rolling(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        n, digits = abs(h), "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while n:
            n, r = divmod(n, 36)
            out = digits[r] + out
        return out or "0"

    for url in ("https://example.com/a", "https://example.com/wave-energy?x=1", ""):
        assert value(U.legacy_hash, url) == rolling(url)


@pytest.mark.parametrize("url,out", [
    ("https://e.com/2024/3/5/x", datetime(2024, 3, 5, 12)),
    ("https://e.com/2020/march/x", datetime(2020, 3, 15, 12)),
    ("https://e.com/20240305/x", datetime(2024, 3, 5, 12)),
    ("https://e.com/a-2024-03-05", datetime(2024, 3, 5, 12)),
    ("https://e.com/1999/12/31/", None),
    ("https://e.com/2024/03/12/", None),
    ("https://e.com/2024/13/40/", None),
    ("https://e.com/plain", None),
    ("https://e.com/2023/2024/3/5", datetime(2024, 3, 5, 12)),
    ("https://e.com/2024//3/5", None),
    ("https://e.com/x2024/3/5", None),
    ("https://e.com/2024-03-05-x", None),
    ("https://e.com/2024-03-05/x", datetime(2024, 3, 5, 12)),
    ("https://e.com/a-20241340-20240305-b", datetime(2024, 3, 5, 12)),
    ("https://e.com/x20240305", None),
    ("https://e.com/2024/13/40/20240305", datetime(2024, 3, 5, 12)),
    ("https://e.com/2020/Sept/x", None),
    ("https://e.com/2020/SEP", datetime(2020, 9, 15, 12)),
    (None, None),
])
def test_date_from_url(value, url, out):
    assert value(lambda c: D.date_from_url(c, NOW), url) == out


@pytest.mark.parametrize("text,out", [
    ("Mon, 05 Feb 2024 10:00:00 GMT", datetime(2024, 2, 5, 10)),
    ("Mon, 5 Feb 2024 10:00:00 +0200", datetime(2024, 2, 5, 8)),
    ("5 Feb 2024 10:00 EST", datetime(2024, 2, 5, 15)),
    ("2024-02-05T10:00:00+01:00", datetime(2024, 2, 5, 9)),
    ("2024-02-05", datetime(2024, 2, 5)),
    ("Feb 5, 2024", datetime(2024, 2, 5)),
    ("yesterday", None), ("", None), ("2024-13-40", None),
])
def test_parse_date(value, text, out):
    assert value(D.parse_date, text) == out


def test_compact_date(value):
    assert value(D.compact_date, "20240205T101500Z") == datetime(2024, 2, 5, 10, 15)
    assert value(D.compact_date, "2024") is None


@pytest.mark.parametrize("cur,prev,pct,direction", [
    (5, 0, 0, "flat"), (7, 8, 12, "down"), (201, 200, 1, "up"), (1001, 1000, 0, "flat"), (0, 4, 100, "down"),
])
def test_trend(value, cur, prev, pct, direction):
    assert value(S.trend_pct, cur, prev) == pct
    assert value(S.trend_dir, cur, prev) == direction


def test_bands_and_rounding(value):
    assert [value(S.band_label, x) for x in (0.8, 0.5, 0.2, 0.19)] == ["high", "medium", "low", "noise"]
    assert value(S.round_half_up, -2.5) == -2
    assert value(S.round_half_up, 2.5) == 3


def test_sql_literals(spark):
    awkward = ["it's", "back\\slash", 'quo"te', "new\nline", "é"]
    assert spark.range(1).select(S.literal_strings(awkward).alias("v")).first().v == awkward
    assert S.literal_table(spark, "a int, b array<string>", [(1, ["x"]), (2, [])]).collect()[1].b == []
    assert spark.range(1).select(S.literal_map({"k'": "v"}).alias("v")).first().v == {"k'": "v"}
