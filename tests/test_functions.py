from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.functions import urls as U

BASES = ["http://a.com/b/c/d?q=1", "https://www.x.org", "http://h:8080/p/", "http://a.com/en/685?page=2&ref=x#top"]
HREFS = ["/The", "../x", "../../../y", "./z", "g", "g/", "//other.com/p", "?y", "#f", "http://abs.com/q#f",
         "g?y#s", "..", ".", "a/./b/../c", "/a/../b", "mailto:x@y", "tel:1", "javascript:void(0)", "",
         " sp ace", "HTTP://UP.com/x", "/x/../../z"]


def test_normalize_link_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string").select(
        "b", "h", U.normalize_link(F.col("b"), F.col("h")).alias("n"))
    for r in df.collect():
        h = r.h
        exp = None if (not h or h.startswith(("mailto:", "tel:", "javascript:", "#"))) else \
            urlparse(urljoin(r.b, h))._replace(fragment="").geturl()
        assert r.n == exp, (r.b, h)


def test_normalize_idempotent(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS[:8]], "b string, h string")
    n1 = df.select("b", U.normalize_link(F.col("b"), F.col("h")).alias("n")).filter("n is not null")
    n2 = n1.select("n", U.normalize_link(F.col("b"), F.col("n")).alias("n2"))
    assert all(r.n == r.n2 for r in n2.collect())


def test_text_helpers(spark):
    samples = ["  a b\tc \n", "\xa0x\xa0", "", "one  two   three", "&amp;lt; &copy; &#65;&#x42; &nbsp;"]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", TX.pystrip(F.col("s")).alias("st"), TX.word_count(F.col("s")).alias("wc"),
        TX.unescape(F.col("s")).alias("un"))
    import html
    for r in df.collect():
        assert r.st == r.s.strip()
        assert r.wc == len(r.s.split())
        assert r.un == html.unescape(r.s)


def test_contact_patterns(spark):
    import re
    txt = "Mail a.b@x.org or c@d.co, call +1 (555) 123-4567; Monday - Friday 9:00"
    r = spark.createDataFrame([(txt,)], "t string").select(
        TX.emails(F.col("t")).alias("e"), TX.phones(F.col("t")).alias("p"),
        TX.opening_hours(F.col("t")).alias("h")).collect()[0]
    assert r.e == sorted(set(re.findall(TX.EMAIL_RE, txt)))
    assert r.p == sorted(set(re.findall(r"(\+?\d[\d\s\-\.\(\)]{7,}\d)", txt)))
    assert r.h == ["Monday - Friday 9:00"]


def test_fetch_class_and_slug(spark):
    df = spark.createDataFrame([("https://www.linkedin.com/in/x",), ("http://blog.youtube.com/a/b/",),
                                ("http://plain.org",)], "u string")
    r = df.select(U.fetch_class(F.col("u")).alias("c"), U.snapshot_slug(F.col("u")).alias("s")).collect()
    assert [x.c for x in r] == ["stealth", "dynamic", "http"]
    assert [x.s for x in r] == ["linkedin_com__in_x", "blog_youtube_com__a_b", "plain_org__home"]
