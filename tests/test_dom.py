from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import SF, html_df
from webrel.operators import dom as D
from webrel.operators import page as P


def golden(name):
    import os
    with open(os.path.join(os.path.dirname(__file__), "golden", name), encoding="utf-8") as f:
        return f.read()


def test_tokens_lossless(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    tok = D.tokenize(pages)
    joined = tok.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))),
                                                                 lambda s: s["tok"]), "").alias("h"))
    bad = joined.join(pages, "page_id").filter(F.col("h") != F.col("html")).count()
    assert bad == 0


def test_script_string_is_not_a_tag(spark):
    d = D.parse(html_df(spark, golden("broken.html")))
    raw = d.tokens.filter("kind = 'raw'").collect()
    assert [r.tok for r in raw] == ['var t="</p>";']
    assert d.elements.filter("tag = 'p'").count() == 3


def test_broken_markup_repair(spark):
    d = D.parse(html_df(spark, golden("broken.html")))
    el = {(r.tag, r.start): r for r in d.elements.collect()}
    div = [r for (t, _), r in el.items() if t == "div"][0]
    # quoted '>' inside an attribute, unquoted and single-quoted values, first duplicate wins
    assert div.attrs["title"] == "a>b" and div.attrs["id"] == "plain" and div.attrs["data-x"] == "single"
    assert div.attrs["class"] == "box main"
    ps = sorted([r for (t, _), r in el.items() if t == "p"], key=lambda r: r.start)
    # an open <p> ends where the next <p> starts; the one in the div ends with the div
    assert ps[0].end == ps[1].start
    assert ps[1].end <= div.end
    lis = sorted([r for (t, _), r in el.items() if t == "li"], key=lambda r: r.start)
    texts = P.deep_parts(d, d.elements.filter("tag = 'li'").select("page_id", "start", "start_tc", "end_tc"))
    got = {r.start: "".join(r.parts) for r in texts.collect()}
    assert [got[r.start] for r in lis] == ["alpha", "betainner", "inner", "gamma"]


def test_intervals_nest(spark):
    d = D.parse(spark.read.parquet(f"{SF}/pages.parquet"))
    e = d.elements.filter("not void").select("page_id", "start", "end")
    a, b = e.alias("a"), e.alias("b")
    crossing = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.start") < F.col("b.start"))
                      & (F.col("b.start") < F.col("a.end")) & (F.col("a.end") < F.col("b.end"))).count()
    assert crossing == 0


def test_entities_and_text(spark):
    d = D.parse(html_df(spark, golden("broken.html")))
    t = P.titles(d).collect()[0].title
    assert t == "Broken & fixed"
    tail = [r.text for r in d.texts.collect() if "tail" in r.text][0]
    assert "© 2024 © A" in tail


class _Collect(HTMLParser):
    TAGS = ("h1", "title", "li")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack = [], []

    def handle_starttag(self, tag, a):
        if tag in self.TAGS:
            self.stack.append([tag, ""])

    def handle_endtag(self, tag):
        if tag in self.TAGS and self.stack and self.stack[-1][0] == tag:
            self.out.append(tuple(self.stack.pop()))

    def handle_data(self, data):
        for it in self.stack:
            it[1] += data


def test_element_text_matches_stdlib_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    d = D.parse(pages)
    sel = d.elements.filter(F.col("tag").isin("h1", "title", "li")).select("page_id", "start", "tag", "start_tc", "end_tc")
    got = sorted((r.page_id, r.tag, "".join(r.parts)) for r in D.with_text_parts(sel, d).collect())
    exp = []
    for r in pages.collect():
        p = _Collect()
        p.feed(r.html)
        exp += [(r.page_id, t, s) for t, s in p.out]
    assert got == sorted(exp)
