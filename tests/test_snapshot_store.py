import math

import pytest
from pyspark.sql import functions as F

from webrel.operators import changes as C
from webrel.sources import io as IO
from webrel.sources.store import SnapshotStore
from webrel.streaming import jobs as J

SNAP = "page_id bigint, url string, snapshot_ts timestamp, title string, tags array<string>"


def snaps(spark, rows):
    """(page_id, url, second)"""
    return spark.createDataFrame([(i, u, f"t{i}", s) for i, u, s in rows], "page_id bigint, url string, title string, s int").select(
        "page_id", "url", F.timestamp_seconds("s").alias("snapshot_ts"), "title", F.array(F.lit("x")).alias("tags"))


def state(store):
    last = store.latest().collect()
    assert len(last) == len({r.url for r in last})
    return sorted((r.page_id, r.url) for r in store.history().collect()), {r.url: r.page_id for r in last}


def test_many_batches_leave_few_runs(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    latest, rows = {}, []
    for b in range(12):
        batch = [(100 * b + k, f"u{(b * 3 + k) % 10}", 1000 * b + k if b != 5 else k) for k in range(4)]   # batch 5 comes late
        store.append(snaps(spark, batch), str(b))
        store.expire()
        rows += batch
        for i, u, s in batch:
            latest[u] = max(latest.get(u, (-1, -1)), (s, i))
    got = state(SnapshotStore(spark, str(tmp_path / "s")))
    assert got == (sorted((i, u) for i, u, _ in rows), {u: i for u, (_, i) in latest.items()})
    g = store.generation()
    assert len([r for r in g.runs if r.kind == "history"]) <= 2 + math.log2(12)
    assert sum(r.n_rows for r in g.runs if r.kind == "latest") <= 3 * len(latest)      # pages known, not their history
    assert len(store.numbers()) == 2
    named = {r.folder for n in store.numbers() for r in store.generation(n).runs}
    assert set(store._names("runs")) == named


def test_repeated_batch_and_generations(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.history() is None and store.latest() is None
    store.append(snaps(spark, [(1, "a", 1), (2, "b", 1)]), "1")
    old = store.generation()
    store.append(snaps(spark, [(3, "a", 2)]), "2")
    store.append(snaps(spark, [(3, "a", 2)]), "2")           # its commit was not seen: repeated
    store.expire()
    store.append(snaps(spark, [(3, "a", 2)]), "2")
    assert state(store) == ([(1, "a"), (2, "b"), (3, "a")], {"a": 3, "b": 2})
    assert sorted(r.page_id for r in store.history(old).collect()) == [1, 2]   # a reader of the generation before
    store._write("history", snaps(spark, [(9, "z", 9)]))      # a writer that ended before its commit
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "s" / "generations" / "gen=000000000099" / "_temporary" / "0"))
    assert state(store)[1] == {"a": 3, "b": 2}
    store.append(snaps(spark, []), "3")
    assert state(store)[1] == {"a": 3, "b": 2}


def test_one_writer(spark, tmp_path):
    a, b = (SnapshotStore(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    a.append(snaps(spark, [(1, "a", 1)]), "1")
    numbers = b.numbers()
    b.numbers = lambda: numbers            # did not see what a commits now
    a.append(snaps(spark, [(2, "b", 1)]), "2")
    with pytest.raises(Exception, match="(?i)exists"):
        b.append(snaps(spark, [(3, "c", 1)]), "3")
    assert state(a)[1] == {"a": 1, "b": 2}


def test_stored_side_is_not_shuffled(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(snaps(spark, [(k, f"u{k}", k) for k in range(40)]), "1")
    store.append(snaps(spark, [(50, "u1", 90)]), "2")
    assert len([r for r in store.generation().runs if r.kind == "latest"]) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = store.join_latest(snaps(spark, [(60, "u1", 99), (61, "u2", 99), (62, "new", 99)]))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1      # the new rows alone
        assert {r.url: r["_old"] and r["_old"].page_id for r in j.collect()} == {"u1": 50, "u2": 2, "new": None}
        other = spark.newSession()
        assert SnapshotStore(other, str(tmp_path / "s")).latest().count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_io_uses_the_same_layout(spark, tmp_path):
    IO.append_snapshot(snaps(spark, [(1, "a", 1)]), str(tmp_path / "s"))
    IO.append_snapshot(snaps(spark, [(2, "a", 2)]), str(tmp_path / "s"))
    assert sorted(r.page_id for r in IO.read_snapshots(spark, str(tmp_path / "s")).collect()) == [1, 2]
    assert C.stored_snapshots(spark, str(tmp_path / "s")).count() == 2
    assert SnapshotStore(spark, str(tmp_path / "s")).latest().first().page_id == 2


def page(k, title):
    return f"<title>{title}</title><body><p>{title} {k}</p></body>"


def test_monitor_stream_restart(spark, tmp_path):
    """Two runs over a growing folder: each capture is compared with the one before it, across the restart."""
    d = str(tmp_path)

    def put(rows):
        spark.createDataFrame([(i, u, t, page(u, x)) for i, u, t, x in rows], "page_id bigint, url string, t int, html string").select(
            "page_id", "url", F.timestamp_seconds("t").alias("snapshot_ts"), "html").coalesce(1).write.mode("append").parquet(f"{d}/in")

    def status():
        return sorted((r.url, r.status) for r in spark.read.parquet(f"{d}/out/status").collect())

    put([(1, "http://a/1", 1, "x"), (2, "http://b/1", 1, "y"), (3, "http://a/1", 2, "x")])
    J.monitor_stream(spark, f"{d}/in", f"{d}/store", f"{d}/out", f"{d}/ck").awaitTermination()
    assert status() == [("http://a/1", "first_snapshot"), ("http://a/1", "no_change"), ("http://b/1", "first_snapshot")]
    put([(4, "http://a/1", 3, "z"), (5, "http://b/1", 3, "y"), (6, "http://c/1", 3, "n")])
    J.monitor_stream(spark, f"{d}/in", f"{d}/store", f"{d}/out", f"{d}/ck").awaitTermination()
    assert status() == [("http://a/1", "changed"), ("http://a/1", "first_snapshot"), ("http://a/1", "no_change"),
                        ("http://b/1", "first_snapshot"), ("http://b/1", "no_change"), ("http://c/1", "first_snapshot")]
    assert SnapshotStore(spark, f"{d}/store").history().count() == 6
