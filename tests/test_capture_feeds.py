import datetime as dt
import tempfile

from conftest import SF

from webrel.operators import requests as N
from webrel.plans import render as R
from webrel.streaming import jobs as J

HOUR = dt.timedelta(hours=1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def feeds_of(spark, d, **kw):
    return J.capture_feeds(spark, f"{d}/req", f"{d}/resp", f"{d}/ws", **kw)


def put(spark, d, logs, mode="append"):
    for df, name in zip(logs, ("req", "resp", "ws"), strict=True):
        df.coalesce(1).write.mode(mode).parquet(f"{d}/{name}")


def test_counters_and_unanswered_equal_batch(spark):
    d = tempfile.mkdtemp(prefix="webrel-feeds-")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    put(spark, d, R.capture_log(ev))
    logs = [spark.read.parquet(f"{d}/{n}") for n in ("req", "resp", "ws")]
    J.run_available_now(J.capture_counters_stream(feeds_of(spark, d)), f"{d}/out", f"{d}/ck")
    want = rows(N.windowed_counters(*logs))
    got = rows(spark.read.parquet(f"{d}/out"))
    seen = min(df.agg({"ts": "max"}).first()[0] for df in logs) - dt.timedelta(minutes=10)   # the slowest feed's watermark
    assert got <= want and got >= {w for w in want if w[0] + HOUR < seen}   # newer windows stay open
    assert len(got) > 100 and all(any(w[k] for w in got) for k in range(1, 6))
    J.run_available_now(J.unanswered_stream(feeds_of(spark, d)), f"{d}/un", f"{d}/ck2")
    want, got = rows(N.unanswered(*logs[:2])), rows(spark.read.parquet(f"{d}/un"))
    assert got <= want and all(w[1] >= max(x[1] for x in want) - HOUR for w in want - got) and len(got) > 50


def log(spark, minutes, first=0):
    """Requests at the given minutes, each answered and announced at once."""
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in minutes]
    req = spark.createDataFrame([(first + i, t, "p", "GET", "https://a.example.com/api/x", "xhr", {}, None) for i, t in enumerate(at)], J.REQUESTS)
    resp = spark.createDataFrame([(first + i, "u", 200, "application/json", "{}", t) for i, t in enumerate(at)], J.RESPONSES)
    return req, resp, spark.createDataFrame([("w", t, "x") for t in at], J.MESSAGES)


def test_restart_and_late_rows(spark):
    """A second run goes on where the first stopped; rows behind the watermark are left out,
    rows that are late but not behind it count."""
    d = tempfile.mkdtemp(prefix="webrel-late-")
    put(spark, d, log(spark, [1, 2, 61, 125, 126]))
    J.run_available_now(J.capture_counters_stream(feeds_of(spark, d)), f"{d}/out", f"{d}/ck")
    put(spark, d, log(spark, [3, 122, 200, 400], 10))       # 3: its window is closed; 122: still open
    J.run_available_now(J.capture_counters_stream(feeds_of(spark, d)), f"{d}/out", f"{d}/ck")
    got = {r.window_start.hour: tuple(r)[1:] for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {0: (2, 2, 2, 0, 2), 1: (1, 1, 1, 0, 1), 2: (3, 3, 3, 0, 3), 3: (1, 1, 1, 0, 1)}


def test_slowest_feed_holds_windows(spark):
    d = tempfile.mkdtemp(prefix="webrel-slow-")
    req, resp, _ = log(spark, [1, 61, 300])
    put(spark, d, (req, resp, log(spark, [1])[2]))
    J.run_available_now(J.capture_counters_stream(feeds_of(spark, d)), f"{d}/out", f"{d}/ck")
    assert spark.read.schema("window_start TIMESTAMP").parquet(f"{d}/out").count() == 0
    more = log(spark, [301], 10)
    put(spark, d, (more[0], more[1], log(spark, [62, 290])[2]))
    J.run_available_now(J.capture_counters_stream(feeds_of(spark, d)), f"{d}/out", f"{d}/ck")
    got = {r.window_start.hour: tuple(r)[1:] for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {0: (1, 1, 1, 0, 1), 1: (1, 1, 1, 0, 1)}


def test_answers_outside_the_interval(spark):
    req, resp, _ = log(spark, [1, 2, 3, 4])
    odd = spark.createDataFrame([(0, dt.datetime(2024, 1, 1, 0, 1, 30)), (1, dt.datetime(2024, 1, 1, 0, 2, 31)),
                                 (2, dt.datetime(2024, 1, 1, 0, 2, 59)), (3, None)], "event_id BIGINT, ts TIMESTAMP")
    assert {r.event_id for r in N.unanswered(req, odd).collect()} == {1, 2, 3}
