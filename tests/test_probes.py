"""Cases that once went wrong on ordinary input, one test each."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import html_df
from webrel.functions import text as TX
from webrel.operators import changes as C
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import page as P
from webrel.operators import requests as N
from webrel.operators import rules as RU
from webrel.operators.select import flag
from webrel.sources import io as IO


def test_references_are_decoded_once(spark):
    cases = {"&amp;#65;": "&#65;", "&pi; &rarr; &Uuml;": "π → Ü", "&#0000000065;&#x0000000041;": "AA", "&#1114112;&#xD800;&#0;": "���",
             "&nosuch; & &; &#; x": "&nosuch; & &; &#; x", "&amp;lt;": "&lt;", "&NotEqualTilde;": "≂̸", "a&lt;b&gt;c": "a<b>c"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string")
    got = {r.s: r.got for r in rows.select("s", TX.unescape(F.col("s")).alias("got")).collect()}
    assert got == cases


def test_nested_table_keeps_the_outer_cells(spark):
    html = ("<table><tr><th>H</th><th>K</th></tr><tr><td>before<table><tr><td>inner</td></tr></table></td><td>after</td></tr>"
            "<tr><td>r2</td><td>r2b</td></tr></table>")
    rows = P.table_rows(D.parse(html_df(spark, html))).collect()
    outer = min(r.table_start for r in rows)
    assert [(r.row_no, r.header, r.value) for r in sorted(rows, key=lambda r: (r.row_no, r.col_no)) if r.table_start == outer and r.col_no] == [
        (1, "K", "after"), (2, "K", "r2b")]
    assert "r2" in {r.value for r in rows} and "inner" in {r.value for r in rows}
    basic = {r.value for r in P.table_rows_basic(D.parse(html_df(spark, html))).collect()}
    assert {"before", "after", "r2", "inner"} <= basic


def test_repeated_headers_and_details(spark):
    html = ("<table><tr><th></th><th></th><th>A</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
            "<dl><dt>Industry</dt><dd>one</dd><dt>Industry</dt><dd>two</dd></dl>")
    dom = D.parse(html_df(spark, html))
    assert P.extract_full(dom).collect()[0].tables[0].rows[0] == {"": "2", "A": "3"}
    assert EN.org_details(dom).collect()[0].industry == "two"


def test_same_company_on_two_pages(spark):
    page = "<body><main><div class='x'><a href='https://www.linkedin.com/company/acme/about'>Acme Inc</a></div></main></body>"
    pages = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.name) for r in EN.link_scan(D.parse(pages)).collect()) == [(1, "Acme Inc"), (2, "Acme Inc")]


def test_cookie_header_in_any_case(spark):
    req = spark.createDataFrame([("http://h/x", {"Cookie": "a=1; b=2"}), ("http://h/y", {"cookie": "a=1"})], "url string, headers map<string,string>")
    assert sorted((r.name, r.n) for r in N.cookie_inventory(req).collect()) == [("a", 2), ("b", 1)]


def test_siblings(spark):
    e = D.parse(html_df(spark, "<div><h2>a</h2><p>1</p><p>2</p><h2>b</h2><ul><li>x</li></ul><p>3</p></div>")).elements
    for sel, want in (("h2 + p", 1), ("h2 ~ p", 3), ("p + p", 1), ("ul ~ h2", 0), ("div > h2 + ul li", 1)):
        assert flag(e, sel, "hit").where("hit").count() == want, sel


def test_long_page_and_many_rules(spark):
    html = "<div>" + "<p>a</p>" * 9000 + "<section>x<b>y</b>z</section></div>"
    dom = D.parse(html_df(spark, html))
    got = RU.extract(dom, [{"field": "t", "selector": "//section//text()", "multiple": True}]).orderBy("idx").collect()
    assert [r.value for r in got] == ["x", "y", "z"]
    rules = spark.createDataFrame([(f"f{k}", "b::text", False, None, None) for k in range(501)], IO.RULE_SCHEMA)
    assert len(RU._as_list(rules)) == 501


def test_rule_profiles_round_trip(spark, tmp_path):
    rules = [("shop", "title", "h1::text", False, None, None), ("shop", "p", "p::text", True, r"\d+", None),
             ("shop", "title", "h2::text", None, None, "id"), ("other", "x", "b", True, None, None)]
    df = spark.createDataFrame(rules, "profile string, field string, selector string, multiple boolean, regex string, attr string")
    IO.write_rules(df.coalesce(1), str(tmp_path / "r"))
    back = IO.read_rules(spark, str(tmp_path / "r"))
    assert [tuple(r) for r in back.where("profile = 'shop'").select("profile", "field", "selector", "multiple", "regex", "attr").collect()] == rules[:3]
    assert {r.profile: r.rules for r in IO.profile_summary(back).collect()} == {"shop": "3", "other": "1"}
    assert IO.read_rules(spark, str(tmp_path / "r"), "other").count() == 1
    with pytest.raises(ValueError, match="no rule profile"):
        IO.read_rules(spark, str(tmp_path / "r"), "none")


def test_json_array_files(spark, tmp_path):
    df = spark.range(50).select("id", F.lit(None).cast("string").alias("n"), F.lit("é").alias("s")).repartition(3)
    IO.write_json(df, str(tmp_path / "j"))
    rows = [r for f in tmp_path.joinpath("j").glob("part-*") for r in json.loads(f.read_text())]
    assert sorted(r["id"] for r in rows) == list(range(50)) and rows[0] == {"id": rows[0]["id"], "n": None, "s": "é"}


def captures(spark, rows):
    return spark.createDataFrame([(i, u, F_TS % i, f"<title>{t}</title><body><p class='price'>$5</p><p>{t}</p></body>") for i, u, t in rows],
                                 "page_id bigint, url string, ts string, html string").select(
        "page_id", "url", F.to_timestamp("ts").alias("snapshot_ts"), "html")


F_TS = "2024-01-01 00:00:%02d"


def test_monitor_batches_may_be_repeated(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    C.monitor_batch(captures(spark, [(1, "http://a/1", "x"), (2, "http://b/1", "y")]), store, out, batch_id=6)
    second = captures(spark, [(3, "http://a/1", "x2"), (4, "http://a/1", "x2"), (5, "http://c/1", "z")])
    for _ in range(2):
        C.monitor_batch(second, store, out, batch_id=7)
    assert C.stored_snapshots(spark, store).count() == 5
    status = spark.read.parquet(f"{out}/status/batch=7").collect()
    assert sorted((r.url, r.status) for r in status) == [("http://a/1", "changed"), ("http://a/1", "no_change"), ("http://c/1", "first_snapshot")]
    C.monitor_batch(captures(spark, [(6, "http://b/1", "y")]), store, out)
    assert C.stored_snapshots(spark, store).count() == 6


def test_a_broken_store_is_not_an_empty_one(spark, tmp_path):
    bad = tmp_path / "store" / "generations" / "gen=000000000001"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"no parquet file at all")
    with pytest.raises(Exception, match=r"(?i)parquet|footer"):
        C.monitor_batch(captures(spark, [(1, "http://a/1", "x")]), str(tmp_path / "store"), str(tmp_path / "out"), batch_id=2)
    assert C.stored_snapshots(spark, str(tmp_path / "none")) is None


def test_snapshots_leave_the_callers_cache(spark):
    pages = captures(spark, [(1, "http://a/1", "x")])
    dom = D.parse(pages).persist()
    C.snapshot_records(dom, pages)
    assert dom.tokens.storageLevel.useMemory
    dom.unpersist()


def test_pages_stop_at_the_first_gap(spark):
    rows = [(p, k) for p in (1, 2, 4) for k in range(3)]
    df = spark.createDataFrame(rows, "p int, k int")
    assert [tuple(r) for r in EN.paged_results(df, "p", "k").collect()] == rows[:6]
    assert EN.paged_results(df.where("p > 1"), "p", "k").count() == 0
    assert EN.paged_results(df.where("p < 3"), "p", "k", 4).count() == 4
