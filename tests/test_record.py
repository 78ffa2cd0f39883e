import json

import pytest
from conftest import html_df
from pyspark.sql import functions as F

from webrel.operators import business as B
from webrel.operators import changes as C
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import graph as G
from webrel.operators import page as P
from webrel.operators import record as RC
from webrel.operators import requests as N
from webrel.operators import rules as RU
from webrel.operators import tree as T
from webrel.operators.select import flag
from webrel.plans import pipelines as PL
from webrel.plans import render as R
from webrel.sources import io as IO


def odd_pages(spark):
    return spark.createDataFrame([(1, "http://a/1", "<title> T </title><body><p>one two three four five six</p></body>"), (2, "http://a/2", None),
                                  (3, "http://a/3", ""), (4, "http://a/4", "plain")], "page_id bigint, url string, html string")


def test_pages_without_tokens_keep_their_row(spark):
    dom = D.parse(odd_pages(spark))
    for rows in (P.titles(dom), P.full_text(dom), P.page_meta(dom), P.extract_full(dom), B.extract_business(dom)):
        assert sorted(r.page_id for r in rows.collect()) == [1, 2, 3, 4]
    full = {r.page_id: r for r in P.extract_full(dom).collect()}
    assert (full[1].title, full[1].full_text, full[2].title, full[2].links, full[4].full_text) == ("T", "one two three four five six", "", [], "")
    assert B.extract_business(dom.persist()).filter("page_id = 3").first().contact.emails == []


PAGE = """<html><body><div id='a' class="x nav-y"><h2>a</h2><p>1</p><p>2<b>bold</b></p><h2>b</h2><ul><li>x</li><li><a href="/u">y</a></li></ul><p>3</p>
<form action="/f"><input name=i><form method=post><select name=s></select></form></form></div><section><p>in</p><section><span>deep</span></section></section>
<table><tr><th>A<th>B</tr><tr><td>1</td><td>2</td></tr><tr><td>only</td></tr></table><table><tr><th>C</th></tr><tr><td>3<table><tr><td>n</td></tr></table></td></tr></table></body></html>"""

SELECTORS = ["p", "div p", "div > p", "h2 + p", "h2 ~ p", "p + p", "ul > li + li a", "li:first-child", "li:last-child", "p:nth-of-type(2)",
             "div > :nth-child(3)", "[class*='nav'] a", "#a .x, .x li, p b", "section section span", "section, p", "body *"]


@pytest.mark.parametrize("html", [PAGE, "<p>a<p>b<b>c<i>d</b>e</i><li>f<li>g", "", "<div>" * 30 + "<p>x</p>"])
def test_selectors_equal_the_window_form(spark, html):
    dom = D.parse(html_df(spark, html))
    pages = T.encode(dom)
    found = T.on_page(lambda p: F.array(*[F.transform(p.select(s), lambda e: e["start"]) for s in SELECTORS]))
    got = pages.select(found.alias("f")).first().f
    for s, starts in zip(SELECTORS, got, strict=True):
        assert starts == [r.start for r in flag(dom.elements, s, "hit").filter("hit").orderBy("start").collect()], s


def test_parents_equal_the_window_form(spark):
    dom = D.parse(html_df(spark, PAGE))
    nodes = T.encode(dom).select(F.explode("nodes").alias("n")).select("n.*").collect()
    want = {r.start: r.parent_start for r in dom.elements.collect()} | {r.pos: r.parent_start for r in dom.texts.collect()}
    assert {n.start: n.parent for n in nodes} == want


def test_rules_that_share_steps(spark):
    dom = D.parse(html_df(spark, PAGE))
    rules = [{"field": f, "selector": s, "multiple": m} for f, s, m in (
        ("a", "div li::text", True), ("b", "div li a::attr(href)", False), ("c", "div li", True), ("d", "//li//text()", True), ("e", "(//p)[2]", True),
        ("f", "p::text, b::text", True))]
    got = {}
    for r in RU.extract(dom, rules).orderBy("field", "idx").collect():
        got.setdefault(r.field, []).append(r.value)
    assert got == {"a": ["x"], "b": ["/u"], "c": ["<li>x</li>", '<li><a href="/u">y</a></li>'], "d": ["x", "y"], "e": ["<p>2<b>bold</b></p>"],
                   "f": ["1", "2", "bold", "3", "in"]}
    plan = RU.items(dom, [{"field": str(k), "selector": f"div p:nth-of-type({k})::text", "multiple": True} for k in range(1, 40)])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3      # not one per rule


def test_tables_keep_to_themselves(spark):
    dom = D.parse(html_df(spark, PAGE))
    rows = lambda i: [(r.key, r.value) for r in P.table_rows_basic(dom, i).orderBy("tr_start", "col_no").collect()]
    assert rows(1) == [("A", "1"), ("B", "2"), ("col_0", "only")]
    assert sorted(rows(2)) == [("C", "3"), ("col_0", "n")]
    assert len(rows(None)) == 5
    tables = P.extract_full(dom).first().tables
    assert [t.rows for t in tables] == [[{"A": "1", "B": "2"}, {"A": "only"}], [{"C": "3 n"}], [{"col_0": "n"}]]


def test_forms_sections_and_structured_data(spark, tmp_path):
    dom = D.parse(html_df(spark, PAGE + '<script type="application/ld+json">{"a": [1, {"b": "c"}]}</script><script type="application/ld+json">bad</script>'))
    full = P.extract_full(dom)
    r = full.first()
    assert [(f.action, f.method, [x.name for x in f.fields]) for f in r.forms] == [("/f", "get", ["i"]), ("", "post", ["s"])]
    assert [(s.heading, s.content) for s in r.sections] == [("", ["in", "deep"]), ("", ["deep"])]
    full.select("page_id", "structured_data").write.parquet(str(tmp_path / "v"))          # VARIANT through files
    back = spark.read.parquet(str(tmp_path / "v")).select(F.explode("structured_data").alias("v"))
    assert [x.b for x in back.select(F.variant_get("v", "$.a[1].b", "string").alias("b")).collect()] == ["c"]


def test_networks_by_host(spark):
    urls = ["https://www.netflix.com/x.com", "https://x.com/a", "//mobile.twitter.com/b", "https://example.com/facebook", "https://facebook.co.uk/", "/x.com", ""]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.p for r in rows.select(RC.platform(F.col("u")).alias("p")).collect()]
    assert got == [None, "x.com", "twitter", None, "facebook", None, None]
    assert [r.p for r in rows.select(RC.platform(F.col("u"), "substring").alias("p")).collect()][:4] == ["x.com", "x.com", "twitter", "facebook"]


def test_price_values(spark):
    cases = {"EUR 1.234": "1234.00", "$1,234.50": "1234.50", "1.234,5 EUR": "1234.50", "$ 1,234": "1234.00", "£12.": "12.00", "$1.234.567": "1234567.00",
             "$0.5": "0.50", "€12,99": "12.99", "$1,234.567": "1234567.00", "10 USD": "10.00"}
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", B.price_value(F.col("p")).alias("v")).collect()
    assert {r.p: str(r.v.amount) for r in rows} == cases


def test_employees_and_amounts(spark):
    js = ('{"employees": ["x", {"first_name": "A", "last_name": "B"}, null, 3], "funding_data": [{"money_raised": "12M", "announced_date": {"year": "2020"}},'
          ' {"money_raised": 5, "lead_investors": [{"name": "I"}, {}]}], "type": "T", "tagline": "t", "linkedin_id": 7}')
    v = spark.createDataFrame([(js,)], "j string").select(F.try_parse_json("j").alias("v"))
    r = v.select(EN.normalize_org(F.col("v"), F.lit("u")).alias("o")).first().o
    assert [e.name for e in r.key_employees] == ["A B"]
    assert [(x.amount, x.amount_text, x.year, x.investors) for x in r.funding.rounds] == [(None, "12M", 2020, []), (5, "5", None, ["I", ""])]
    assert (r.company_type, r.tagline, r.linkedin_id, r.source) == ("T", "t", "7", "company_payload")


def test_selector_is_the_shortest_and_finds_its_element(spark):
    dom = D.parse(html_df(spark, PAGE))
    for text, want in (("bold", "b:nth-of-type(1)"), ("deep", "span:nth-of-type(1)"), ("3", "p:nth-of-type(3)"), ("in", "section:nth-of-type(1) > p:nth-of-type(1)")):
        sel = RU.selector_for(dom, text).first().selector
        assert sel == want
        hit = flag(dom.elements, sel, "hit").filter("hit").collect()
        assert len(hit) == 1 and text in "".join(r.text for r in dom.texts.filter(F.col("parent_start") == hit[0].start).collect())
    assert RU.selector_for(dom, "nowhere").count() == 0


def test_adhoc_display_and_scrape(spark):
    dom = D.parse(html_df(spark, PAGE))
    assert [r.value for r in RU.adhoc(dom, css="li::text", xpath="//p")["matches"].collect()] == ["x"]
    assert [r.value for r in RU.adhoc(dom, xpath="//b/text()")["matches"].collect()] == ["bold"]
    out = RU.adhoc(dom, n_text=3)
    assert set(out) == {"meta", "links", "text"} and out["text"].count() == 3
    assert set(RU.scrape(dom)) == {"meta", "text"} and set(RU.scrape(dom, rules=[{"field": "x", "selector": "b::text"}], links=True)) == {"rules", "links"}
    long = spark.createDataFrame([("a" * 400, ["b" * 300], None, 1)], "s string, l array<string>, n string, i int")
    assert [len(x) for x in RU.display(long).first()] == [150, 150, 0, 1]
    assert len(RU.display(long, record=True).first().s) == 200


def test_reports_and_small_operators(spark):
    sm = spark.createDataFrame([("s", f"http://s/{'u' * 90}{k}", k, "t" * 60, 1, 0, 0) for k in range(40)],
                               "site string, url string, rank int, title string, internal_links_found int, path_depth int, bfs_depth int")
    rep = G.sitemap_report(sm).collect()
    assert len(rep) == 30 and len(rep[0].url) == 80 and len(rep[0].title) == 50
    visited = spark.createDataFrame([("http://a/1",), ("http://a/9",)], "url string")
    assert [r.page_id for r in G.crawl_with(odd_pages(spark), visited, lambda p: P.titles(D.parse(p))).collect()] == [1]
    changes = spark.createDataFrame([("u", "title_changed", "a", "b" * 300, None, None)], "url string, type string, old string, new string, value string, word_diff int")
    line = C.diff_report(changes.withColumns({"old_words": F.lit(None).cast("int"), "new_words": F.lit(None).cast("int")})).first().detail
    assert line.startswith("old: a | new: bbb") and len(line) == 200
    req, resp, _ = R.capture_log(spark.createDataFrame(
        [(k, None, k, "signup", 1.0, "{}") for k in range(40)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"))
    out = N.capture_report(req, resp)
    assert out["api_calls"].count() == 30 and out["graphql"].count() == 40 and out["auth"].count() == 2
    texts = spark.createDataFrame([(["a", "Follow", "a", "Connect", "b"], "About 1,234 results", "none")], "t array<string>, n string, z string")
    r = texts.select(EN.ui_label_filter(F.col("t")).alias("t"), EN.total_results(F.col("n")).alias("n"), EN.total_results(F.col("z")).alias("z")).first()
    assert "a" in r.t and "b" in r.t and len(r.t) < 4 and (r.n, r.z) == (1234, 0)
    kept = EN.drop_empty(spark.createDataFrame([("", 0, "x")], "a string, b int, c string"), ["a", "c"]).first()
    assert tuple(kept) == (None, 0, "x")


def test_page_pipelines(spark):
    pages = odd_pages(spark)
    out = PL.full_with_monitor(pages.withColumn("snapshot_ts", F.lit("2024-01-01").cast("timestamp")), None)
    assert {r.status for r in out["status"].collect()} == {"first_snapshot"} and out["full"].count() == out["business"].count() == 4
    site = spark.createDataFrame([(1, "http://a.example.com/", '<a href="/b">b</a>'), (2, "http://a.example.com/b", "<h1>B</h1>"),
                                  (3, "http://a.example.com/c", "x")], "page_id bigint, url string, html string")
    res = PL.crawl_business(site, site.filter("page_id = 1").select("url"))
    assert sorted(r.page_id for r in res["full"].collect()) == [1, 2] and res["business"].count() == 2


def test_unreadable_records_go_to_quarantine(spark, tmp_path):
    good = [{"url": "http://a", "ts": "2024-01-01T00:00:00Z", "data": f"d{k}"} for k in range(3)]
    lines = [*map(json.dumps, good), "", "{broken", "[1]", '"text"', '{"url": {"a": 1}, "ts": "never"}', "   "]
    (tmp_path / "ws.json").write_text("\n".join(lines))
    ok, bad = IO.read_capture_log_checked(spark, str(tmp_path / "ws.json"), "ws_messages")
    assert sorted(r.data for r in ok.collect()) == ["d0", "d1", "d2"] and ok.columns == IO.read_capture_log(spark, str(tmp_path / "ws.json"), "ws_messages").columns
    got = sorted((r.reason, r.record) for r in bad.collect())
    assert got == [("a field of another type", '{"url": {"a": 1}, "ts": "never"}'), ("no JSON", "{broken"), ("no object", '"text"'), ("no object", "[1]")]
    assert bad.first().file.endswith("ws.json") and ok.count() + bad.count() == sum(1 for x in lines if x.strip())
    ok, bad = IO.read_entities_checked(spark, str(tmp_path / "ws.json"))
    assert (ok.count(), sorted(r.reason for r in bad.collect())) == (5, ["no JSON", "no object or list"])
    assert IO.read_entities(spark, str(tmp_path / "ws.json")).filter("payload is not null").count() == 6
