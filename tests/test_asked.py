"""Pages read only as far as a query asks for (``D.Asked``, ``T.asked_on_page``)."""

import random
import re

from pyspark.sql import functions as F

from webrel.functions.text import PRICE_KEYWORDS, has_keyword
from webrel.operators import business as B
from webrel.operators import dom as D
from webrel.operators import record as RC
from webrel.operators import tree as T
from webrel.plans import render as R

BITS = ["<div class='price-box plan'>", "</div>", "<h2 class='title'>", "</h2>", "<p>", "</p>", "<li>", "</ul>", "<ul id='plans'>", " a ", "$5 ", "per month",
        "<b>", "</b>", "<form action='/x' class='btn-form'>", "</form>", "<input name='n'>", "<a href='https://x.com/1' class='btn'>", "</a>", "<br>", "&amp;",
        "<table>", "</table>", "<tr>", "<th>h", "<td>c", "</tr>", "<title>t</title>", "<meta name='description' content='d'>", "<script>1<2</script>",
        "<body>", "</body>", "<nav>", "</nav>", "<img src='i' alt='a'>", "<span class='number'>3</span>", "<section>", "</section>", "<!-- c -->"]


def _broken_pages(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_parts_of_pages_read_as_asked_equal_those_of_whole_pages(spark):
    pages = spark.createDataFrame(list(enumerate([None, "", *_broken_pages(120)])), "page_id int, html string")
    dom = D.parse(pages)
    rest = {k: v for k, v in RC.PARTS.items() if k not in ("structured_data", "title", "tables", "buttons_cta", "social_links")}
    groups = [
        {"title": RC.raw_title, "meta": lambda p: F.struct(*[c.alias(k) for k, c in RC.meta(p).items()])},
        {"pricing": B.pricing}, {"buttons": RC.buttons, "social": RC.social_links},
        {"tables": RC.tables, "rows": RC.table_rows, "basic": RC.table_rows_basic},
        {**rest, "services": B.services, "stats": B.key_stats, "contact": B.contact,
         "last": lambda p: F.transform(p.select("li:last-child, p + p, ul > li"), lambda e: e["start"])}]
    for group in groups:
        whole = T.on_page(lambda p, group=group: F.struct(*[part(p).alias(name) for name, part in group.items()]))
        want = T.encode(dom).select("page_id", F.to_json(whole).alias("x")).collect()
        got = RC.parts(dom, **group).select("page_id", F.to_json(F.struct(*group)).alias("x")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), list(group)
        assert len({x for _, x in got}) > 1, list(group)


def test_only_what_is_asked_for_is_handed_over():
    asked = D.Asked(conditions={("a", (("href", "x.com"),)), (None, (("class", "price"),))})
    html = "<p class='x'>1</p><a href='/y'>2</a><a href='//x.com/'>3<b>4</b></a><i class='my-price'>5</i><u>6"
    [page] = asked.read([html]).to_pylist()
    assert [(e["tag"], e["text_at"], e["n_texts"]) for e in page["els"]] == [("a", 0, 2), ("i", 2, 1)]
    assert page["texts"] == ["3", "4", "5"]


def test_tokens_equal_the_pattern():
    pattern, r = re.compile(D.TOKEN_RE, re.ASCII), random.Random(2)
    bits = ["<", ">", "/", '"', "'", "a", "B", " ", "\n", "=", "!", "--", "<!--", "-->", "<script", "</SCRIPT >", "<Style>", "</style>", "<textarea x='1'>",
            "</textarea\n>", "<p class=\"x\">", "</p>", "ſ", "K", "<ſcript>", "<td", "<a href='x\"y'>", "<!d"]
    for _ in range(20_000):
        html = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert D._PY_TOKEN.findall(html) == pattern.findall(html), html


def test_keywords_are_found_as_parts_of_lower_cased_text(spark):
    texts = ["PRICE", "x Per Month y", "permonth", "", "floor plan\n", "café", None, "\\Qfee\\E"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", has_keyword(F.col("t"), PRICE_KEYWORDS)).collect()
    want = [None if t is None else any(k in t.lower() for k in PRICE_KEYWORDS) for t in texts]
    assert [x for _, x in sorted(got, key=lambda row: row[0])] == want


def test_rendered_pages_are_read_by_many_tasks(spark):
    """The rows are few bytes, so adaptive execution would read their pages in one task."""
    orders = spark.createDataFrame([(i, float(i)) for i in range(200)], "o_custkey long, o_totalprice double")
    dom = D.parse(R.stat_pages(orders))
    tasks = dom.html.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1


def _tokens_of(htmls: list[str]) -> list[list[tuple[str, bool]]]:
    coded = D._coded(htmls)
    toks = coded.different.take(D.pa.array(coded.code)).to_pylist()
    return [[(t, bool(r)) for t, r, p in zip(toks, coded.raw, coded.page, strict=True) if p == i] for i in range(len(htmls))]


def test_tokens_cut_at_brackets_equal_the_pattern():
    r = random.Random(9)
    bits = ["<", ">", "'", '"', " ", "é😀", "<a href='x'>", "</a>", "<p/ x=\"y\"z>", "<a title=\"it's\">", "<a b=\"c>d\">", "<a\"b c>", "<!-- c -->", "<!-- <b> -->",
            "<!-->", "<!doctype html>", "<!d \"<\">", "<script>", "<scRipt x='>'>", "</script\n>", "</SCRIPT>", "</script x>", "<textarea>", "</textarea>", "<style-x>",
            "</style>", "var t = '</p>';", "a & b", "&amp;", "<script a=</b>", "<ſcript>"]
    htmls = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    for some in (htmls[i:i + 8] for i in range(0, len(htmls), 8)):
        want = []
        for html in some:
            toks, raws = D._tokens(html)
            want.append([(t, i in raws) for i, t in enumerate(toks)])
        assert _tokens_of(some) == want, some


def test_plain_pages_need_no_pattern(monkeypatch):
    """Pages without brackets inside markup are cut as bytes, also around scripts that hold markup."""
    def no_pattern(html):
        raise AssertionError(html)

    monkeypatch.setattr(D, "_tokens", no_pattern)
    html = "<!DOCTYPE html><p class='x'>1 &amp; é<!-- c --><script>'<b>' > 2</script><textarea></textarea><br/>"
    [page] = D.Asked(conditions={("p", ()), ("textarea", ())}).read([html]).to_pylist()
    assert [(e["tag"], e["attrs"]) for e in page["els"]] == [("p", [("class", "x")]), ("textarea", [])]
    assert page["texts"] == ["1 & é", "'<b>' > 2", ""]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_pages_move_no_html_and_forms_are_read_once(spark, tmp_path):
    from webrel.plans import catalog
    catalog.load_all()
    part = spark.createDataFrame([(k, f"n{k}", "B#1", "T", 3, 9.5) for k in (1, 2, None, 7, 7)],
                                 "p_partkey int, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    links = catalog.QUERIES["social_links"](spark, str(tmp_path))
    assert _plan(links).count("Exchange") == 1 and sorted(r["platform"] for r in links.collect()) == ["twitter", "x.com"]
    forms = catalog.QUERIES["forms"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in _plan(forms)
    # the join keeps its meaning: pages that share an id meet each other, pages without an id are left out
    assert sorted(r["page_id"] for r in forms.collect()) == [1] * 3 + [2] * 3 + [7] * 12


def test_attributes_need_no_parents(spark, tmp_path):
    from webrel.plans import catalog
    catalog.load_all()
    spark.createDataFrame([(1, "u", "<p id=a><b class='c'>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    attrs = catalog.QUERIES["attrs"](spark, str(tmp_path))
    assert "parent_start" not in _plan(attrs)
    assert [tuple(r) for r in attrs.orderBy("start").collect()] == [(1, 0, "p", "id", "a"), (1, 1, "b", "class", "c")]
