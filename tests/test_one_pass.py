"""A page is read once: no window, join or second parse per part, and pages that share an id stay apart."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from webrel.operators import business as B
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import page as P
from webrel.operators import profiles as PR
from webrel.operators import rules as RU
from webrel.plans import render as R

PAGE = ("<html><body><nav><a href='https://www.linkedin.com/in/me'>Me</a></nav><main><div class='price'><h2>Plan</h2><p>$5.00 a month</p></div>"
        "<table><tr><th>H</th></tr><tr><td>v</td></tr></table><form action='/f'><input name='q'><form><select name='s'></select></form></form>"
        "<button>Go</button><img src='/i.png'><a href='https://x.com/a'>us</a>"
        "<ul><li><a href='https://www.linkedin.com/in/ann/'>Ann</a><div><span>Head of Work</span></div><p>Town</p></li>"
        "<li><a href='https://www.linkedin.com/company/acme/about'>Acme</a><p>Makes things</p></li></ul></main></body></html>")
PARTS = {
    "tables": P.table_rows, "buttons": P.buttons, "images": P.images, "social": P.social_links, "json": P.json_ld, "meta": P.page_meta,
    "pricing": lambda d: B.rows(d, B.pricing), "profile": PR.person_profile, "people": PR.person_search, "orgs": EN.org_search,
    "selector": lambda d: RU.selector_for(d, "Go"), "sections": lambda d: P.sections(d)[0], "fields": lambda d: P.forms(d)[1],
}


def pages(spark, *ids):
    return spark.createDataFrame([(i, f"http://a/{k}", PAGE) for k, i in enumerate(ids)], "page_id bigint, url string, html string")


@pytest.mark.parametrize("name", PARTS)
def test_one_reading_per_page(spark, name):
    plan = PARTS[name](D.parse(pages(spark, 1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", PARTS)
def test_pages_that_share_an_id_stay_apart(spark, name):
    one = [tuple(map(str, r)) for r in PARTS[name](D.parse(pages(spark, 7))).collect()]
    two = [tuple(map(str, r)) for r in PARTS[name](D.parse(pages(spark, 7, 7))).collect()]
    assert sorted(two) == sorted(one * 2)


def test_rows_of_the_page(spark):
    dom = D.parse(pages(spark, 1))
    assert [(r.row_no, r.col_no, r.header, r.value) for r in P.table_rows(dom).collect()] == [(1, 0, "H", "v")]
    assert [tuple(r)[2:] for r in PR.person_search(dom).collect()] == [("Ann", "https://www.linkedin.com/in/ann", "Head of Work", "Town", "dom_link")]
    assert [tuple(r)[2:] for r in EN.org_search(dom).collect()] == [("Acme", "https://www.linkedin.com/company/acme", "Makes things", "", "link_scan")]
    assert [r.selector for r in RU.selector_for(dom, "Go").collect()] == ["button:nth-of-type(1)"]
    forms, fields = P.forms(dom)
    assert forms.count() == 2 and sorted((r.name, r.type) for r in fields.collect()) == [("q", "text"), ("s", "text")]


def test_crossing_and_open_tags(spark):
    html = "<b><i>x</b>y</i><p>one<p>two<ul><li>a<li>b</ul><br>t<td>c<td>d"
    dom = D.parse(spark.createDataFrame([(1, html)], "page_id int, html string"))
    spans = [(r.tag, r.start, r.end, r.parent_start) for r in dom.elements.orderBy("start").collect()]
    assert spans == [("b", 0, 3, None), ("i", 1, 5, 0), ("p", 6, 8, None), ("p", 8, 10, None), ("ul", 10, 15, None), ("li", 11, 13, 10),
                     ("li", 13, 15, 10), ("br", 16, 16, None), ("td", 18, 20, None), ("td", 20, 22, None)]
    assert [r.text for r in dom.texts.orderBy("pos").collect()] == ["x", "y", "one", "two", "a", "b", "t", "c", "d"]


def test_deep_page_is_linear(spark):
    html = "<div>" * 20000 + "x" + "</div>" * 20000
    dom = D.parse(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert dom.elements.agg(F.max("depth")).collect()[0][0] == 19999


def test_workers_need_no_repository(tmp_path):
    """Tasks run where the package cannot be imported, as on a cluster."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from webrel.session import get_spark\nfrom webrel.operators import dom as D\n"
            "spark = get_spark('local[1]', 1)\n"
            "print('titles', D.parse(spark.sql(\"select 1 page_id, '<p>a &amp; b' html\")).texts.collect()[0].text)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"WEBREL_DRIVER_MEMORY": "1g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "titles a & b" in out.stdout, out.stderr[-2000:]


def test_payloads_are_made_by_all_tasks(spark):
    customers = spark.range(100).coalesce(1).selectExpr("id c_custkey", "'n' c_name")
    payloads = R.person_payloads(customers)
    assert payloads.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and payloads.count() == 100


def test_first_experience_is_current(spark):
    rows = [('{"experiences": [{"title": "a", "company": "b"}, {"title": "c"}]}', "a", "b"), ('{"experiences": [null, {"title": "c"}]}', "", ""),
            ('{"experiences": "x"}', "", ""), ("{}", "", "")]
    df = spark.createDataFrame(rows, "payload string, title string, company string")
    got = df.select("title", "company", EN.normalize_person(F.try_parse_json("payload"), F.lit("u")).alias("p")).collect()
    assert all((r.p.current_title, r.p.current_company) == (r.title, r.company) for r in got)


def test_pages_read_together_equal_pages_read_alone():
    """Tokens of several pages are read at once; nothing of a page reaches the next, and the tokens come only where asked for."""
    bits = ["<div>", "</div>", "<p>", "<b>", "<i>", "</b>", "</i>", "<br>", "<a href='/x&amp;y' HREF=2>", "</a>", "<li>", "x &lt; y", "<", "<!-- c -->",
            "<script>'</p>'</script>", "<style</a>", "<table>", "<tr>", "<td>", "</table>", "<h1"]
    rng = random.Random(3)
    htmls = ["", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)), ""]
    together = D._pages(htmls, True).to_pylist()
    assert together == [D._pages([h], True).to_pylist()[0] for h in htmls]
    assert all("".join(t["tok"] for t in p["toks"]) == h for p, h in zip(together, htmls, strict=True) if "<style</a>" not in h)
    assert D._pages(htmls, False).to_pylist() == [{k: p[k] for k in ("txt", "nodes")} for p in together]
