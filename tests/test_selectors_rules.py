from conftest import html_df
from webrel.operators import dom as D
from webrel.operators import rules as RU
from webrel.operators.select import parse_css, parse_xpath

HTML = """<html><head><title>T</title></head><body><nav class="menu"><a href="/a">A</a><a href="/b">B</a></nav>
<div class="card main"><h2>Plan <span>Pro</span></h2><p>Only $9.99 per month</p><a href="/buy" class="btn">Buy</a></div>
<ul><li>one</li><li>two <a href="/two">2</a></li><li>three</li></ul></body></html>"""


def test_parse_forms():
    s = parse_css("nav a::attr(href), div.card > h2::text")
    assert s.pseudo_element == "text" and len(s.chains) == 2
    x = parse_xpath('//div[@class="card main"]//text()')
    assert x.pseudo_element == "alltext"


def test_rules_long_form(spark):
    d = D.parse(html_df(spark, HTML))
    rules = [
        {"field": "title", "selector": "title::text"},
        {"field": "nav", "selector": "nav a::text", "multiple": True},
        {"field": "hrefs", "selector": "nav a", "attr": "href", "multiple": True},
        {"field": "price", "selector": "div.card p::text", "regex": r"\$\d+\.\d+"},
        {"field": "second", "selector": "//li[2]/text()"},
        {"field": "h2", "selector": "div.card > h2::text"},
        {"field": "title", "selector": "h2 span::text"},
    ]
    got = {}
    for r in RU.extract(d, rules).collect():
        got.setdefault(r.field, []).append((r.idx, r.value))
    assert got["nav"] == [(0, "A"), (1, "B")]
    assert got["hrefs"] == [(0, "/a"), (1, "/b")]
    assert got["price"] == [(0, "$9.99")]
    assert got["second"] == [(0, "two ")]
    assert got["h2"] == [(0, "Plan ")]
    assert got["title"] == [(0, "Pro")]  # later rule with the same field wins


def test_outer_html_and_find(spark):
    d = D.parse(html_df(spark, HTML))
    it = RU.items(d, [{"field": "x", "selector": "li"}]).orderBy("pos").collect()
    assert it[0].value == "<li>one</li>"
    f = RU.find_by_text(d, "thr").collect()
    assert [(r.tag, r.text) for r in f] == [("li", "three")]
    sel = RU.selector_for(d, "three").collect()[0].selector
    assert sel.endswith("li:nth-of-type(3)")


PEOPLE = """<html><body><nav><a href="https://www.linkedin.com/in/navguy">Nav Guy</a></nav><main>
<ul><li><div class="card"><a href="https://www.linkedin.com/in/ana-p?trk=x"><span aria-hidden="true">Ana P</span></a>
<span>Director of Ops</span><span>Connect</span><span>Madrid</span></div></li>
<li><a href="https://www.linkedin.com/in/ana-p/">Ana again</a></li>
<li><a href="https://www.linkedin.com/in/bo/detail/skills">Bo</a></li>
<li><a href="https://www.linkedin.com/in/undefined">X</a></li></ul></main></body></html>"""


def test_person_link_scan_and_closest(spark):
    from webrel.operators import entities as EN
    from webrel.operators.select import flag, nearest_ancestor
    d = D.parse(html_df(spark, PEOPLE))
    rows = EN.link_scan(d, "in").collect()
    assert [(r.name, r.url, r.headline, r.location) for r in rows] == [
        ("Ana P", "https://www.linkedin.com/in/ana-p", "Director of Ops", "Madrid")]
    e = flag(d.elements, "li", "_li")
    anc = nearest_ancestor(e, "_li", "li_anc")
    spans = anc.filter("tag = 'span'").select("li_anc").distinct().collect()
    lis = sorted(r.start for r in d.elements.filter("tag = 'li'").collect())
    assert [r.li_anc for r in spans] == [lis[0]]
