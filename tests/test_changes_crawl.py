from collections import deque

from pyspark.sql import functions as F

from conftest import SF
from webrel.operators import changes as C
from webrel.operators import dom as D
from webrel.operators import graph as G
from webrel.plans import render as R


def test_compare_self_is_no_change(spark):
    v = R.page_versions(spark.read.parquet(f"{SF}/pages.parquet")).filter("version = 0")
    s = C.snapshot_records(D.parse(v), v)
    st, ch = C.compare(s, s)
    assert {r.status for r in st.collect()} == {"no_change"}
    assert ch.count() == 0


def test_compare_mirrors(spark):
    v = R.page_versions(spark.read.parquet(f"{SF}/pages.parquet"))
    s = C.snapshot_records(D.parse(v), v)
    old, new = s.filter("page_id % 2 = 0"), s.filter("page_id % 2 = 1")
    _, ab = C.compare(old, new, deep=True)
    _, ba = C.compare(new, old, deep=True)
    flip = {"added": "removed", "removed": "added"}
    a = sorted((r.url, r.type.rsplit("_", 1)[0] + "_" + flip.get(r.type.rsplit("_", 1)[1], r.type.rsplit("_", 1)[1]),
                r.value) for r in ab.collect() if r.value is not None)
    b = sorted((r.url, r.type, r.value) for r in ba.collect() if r.value is not None)
    assert a == b


def test_records_of_pages_are_not_broadcast(spark, monkeypatch, tmp_path):
    part = spark.createDataFrame([(k, f"part {k}", "Brand#1", "TIN", 1, 10.0) for k in (1, 2, 3, 3, None)],
                                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(str(tmp_path / "part"))   # a file tells its size, which is small
    v = R.part_pages(spark.read.parquet(str(tmp_path / "part"))).withColumn("snapshot_ts", F.lit("2024-01-01").cast("timestamp"))
    monkeypatch.setattr(C, "written", lambda df, name: df)
    s = C.snapshot_records(D.parse(v), v)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.page_id or 0, r.title) for r in s.collect()) == [(0, ""), (1, "part 1"), (2, "part 2"), *[(3, "part 3")] * 4]


def _python_crawl(pages, start):
    """FIFO crawl as the reference does it, over a dict url -> [links]."""
    visited, queue, order = set(), deque([start]), []
    while queue:
        u = queue.popleft()
        if u in visited:
            continue
        visited.add(u)
        order.append(u)
        for n in pages.get(u, []):
            if n not in visited and n not in queue:
                queue.append(n)
    return order


def test_bfs_equals_queue(spark):
    pages = R.site_pages(spark.read.parquet(f"{SF}/supplier.parquet"))
    dom = D.parse(pages)
    e = G.site_edges(dom, pages)
    seeds = pages.filter(F.col("url").endswith(".example.com/")).select("url")
    out = G.crawl(pages, seeds)["visited"].collect()
    links = {}
    for r in e.orderBy("src", "pos").collect():
        links.setdefault(r.src, []).append(r.dst)
    for s in seeds.collect():
        exp = _python_crawl(links, s.url)
        site = s.url.split("/")[2]
        got = [r.url for r in sorted((r for r in out if r.site == site), key=lambda r: r.rank)]
        assert got == exp
    ranks = sorted(r.rank for r in out if r.site == out[0].site)
    assert ranks == list(range(1, len(ranks) + 1))


def test_ranks_are_dense_for_two_million_rows_of_one_key(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.lit("s").alias("site"), F.xxhash64("id").alias("o"), F.col("id").alias("payload"),
                                 F.concat(F.lit("http://s/"), F.col("id")).alias("url"))
    got = G.rank_within(rows, "site", ["o", "payload"], "rank").select("rank", "payload", "url", "o")
    r = got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.countDistinct("payload"), F.max(F.length("url"))).first()
    assert tuple(r)[:4] == (n, 1, n, n)
    steps = got.select("rank", F.col("o").alias("a")).join(got.select((F.col("rank") - 1).alias("rank"), F.col("o").alias("b")), "rank")
    assert steps.where("a > b").count() == 0


def test_chain_of_more_than_thousand_pages(spark):
    e = spark.range(1500).select(F.lit("s").alias("site"), F.concat(F.lit("p"), F.col("id")).alias("src"),
                                 F.concat(F.lit("p"), F.col("id") + 1).alias("dst"))
    e = e.unionByName(spark.createDataFrame([("s", "p1500", "p700")], "site string, src string, dst string"))
    seeds = spark.createDataFrame([("s", "p0"), ("t", "alone")], "site string, url string")
    got = {r.url: r for r in G.follow(seeds, e).collect()}
    assert len(got) == 1502 and all(got[f"p{k}"].rank == k + 1 for k in range(1501))
    assert got["p1500"].parent == "p1499" and got["alone"].rank == 1 and got["p7"].seed == "p0"
    assert max(r.rank for r in G.follow(seeds, e, max_pages=1203).collect()) == 1203


def test_levels_end_only_when_nothing_new_is_reached(spark):
    e = spark.range(12).select(F.lit("s").alias("site"), F.concat(F.lit("p"), F.col("id")).alias("src"), F.lit(0).alias("pos"),
                               F.concat(F.lit("p"), F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([("s", "p0")], "site string, url string")
    v = G.bfs(seeds, e)
    assert {r.url: (r.rank, r.bfs_depth) for r in v.collect()} == {f"p{k}": (k + 1, k) for k in range(13)}
    assert dict(v.dtypes)["rank"] == "bigint"
    assert G.bfs(seeds, e, max_pages=5).count() == 5


def test_levels_read_few_runs(spark, monkeypatch):
    """Two chains with shortcuts and a loop, few buckets: ranks as a queue gives them; seen pages lie in few runs."""
    monkeypatch.setattr(G, "SEEN_BUCKETS", 3)
    links = [("s", f"p{k}", 0, f"p{k + 1}") for k in range(9)] + [("s", "p4", 1, "p0"), ("s", "p2", 1, "p9"), ("s", "p9", 0, "q"), ("t", "p0", 0, "p1")]
    e = spark.createDataFrame(links, "site string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("s", "p0"), ("t", "p0")], "site string, url string")
    got = {(r.site, r.url): (r.rank, r.parent) for r in G.bfs(seeds, e).collect()}
    out = {}
    for _, src, pos, dst in sorted(x for x in links if x[0] == "s"):
        out.setdefault(src, []).append(dst)
    order = _python_crawl(out, "p0")
    assert [u for (s, u), _ in sorted(got.items(), key=lambda g: g[1][0]) if s == "s"] == order
    assert got["t", "p1"] == (2, "p0") and len([g for g in got if g[0] == "t"]) == 2
    assert G.bfs(seeds, e, 2).count() == 4
