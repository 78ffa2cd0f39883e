import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF
from webrel.operators import business as B
from webrel.operators import dom as D
from webrel.operators import page as P
from webrel.plans import pipelines as PL
from webrel.plans import render as R
from webrel.sources import io as IO


def test_extract_full_and_business_records(spark):
    parts = R.part_pages(spark.read.parquet(f"{SF}/part.parquet")).filter("page_id in (1, 7, 10)")
    dom = D.parse(parts)
    full = {r.page_id: r for r in P.extract_full(dom).collect()}
    r1 = full[1]
    assert r1.forms[0].method == "post" and [f.name for f in r1.forms[0].fields] == ["qty", "sku", "note"]
    assert r1.tables[0].rows[0]["Brand"].startswith("Brand#")
    assert len(r1.structured_data) == 1 and len(full[10].structured_data) == 0  # broken JSON-LD skipped
    assert r1.social_links[0].platform == "twitter"
    biz = {r.page_id: r for r in B.extract_business(dom).collect()}
    assert biz[7].pricing[0].label == "fee-box"  # fallback only where no price class exists
    assert biz[1].pricing[0].prices_found[0].startswith("$")


def test_deep_pipeline_outputs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    req, resp, ws = R.capture_log(spark.read.parquet(f"{SF}/events.parquet"))
    out = PL.deep(pages, req, resp, ws)
    assert set(out) == {"full", "business", "snapshot", "capture_stats"}
    assert out["full"].count() == pages.count()
    assert out["capture_stats"].collect()[0].total_requests == spark.read.parquet(f"{SF}/events.parquet").count()


def test_writers_and_rules_io(spark):
    d = tempfile.mkdtemp(prefix="webrel-io-")
    df = spark.createDataFrame([(1, "é", ["a", "b"])], "id int, s string, arr array<string>")
    written = IO.write_all(df, d, "all")
    assert len(written) == 3
    csv_rows = spark.read.option("header", True).csv(written[2]).collect()
    assert json.loads(csv_rows[0].arr) == ["a", "b"] and csv_rows[0].s == "é"
    assert IO.write_all(df, d + "/none", "xml") == []
    os.makedirs(f"{d}/rules")
    with open(f"{d}/rules/shop.json", "w") as f:
        json.dump([{"field": "title", "selector": "h1::text"}, {"field": "p", "selector": "p::text",
                                                               "multiple": True}], f)
    with open(f"{d}/rules/broken.json", "w") as f:
        f.write("[{not json")
    rules = IO.read_rules(spark, f"{d}/rules/*.json")
    summ = {r.profile: r.rules for r in IO.profile_summary(rules).collect()}
    assert summ == {"shop": "2", "broken": "?"}
    slug = spark.createDataFrame([("https://www.a.b.com/x",)], "u string").select(
        IO.output_slug(F.col("u"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("s")).collect()[0].s
    assert slug == "a_b_com_20240102_030405"
