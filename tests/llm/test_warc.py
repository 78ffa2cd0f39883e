import base64
import glob
import gzip
import hashlib

from webrel.llm import warc


def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""),
            (5, "http://a/5", "é" * 40 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
            (6, "http://b", "\r\n\r\n\r\n\r\n"), (7, "http://b/7", "z" * 1000), (None, "http://n", "null id"), (8, "http://b/8", "null id"),
            (2, "http://a/2", "<p>x</p>"), (9, "http://a/9", "\r\n"), (10, "http://a/10", "ends\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, digest string, no int")


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    path = warc.archive(df.coalesce(1), chunk=7, path=str(tmp_path / "a"))
    chunks = warc.read(spark, path).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r["no"]):
        if r["type"] == "response":
            whole[r["id"]] = whole.get(r["id"], b"") + bytes(r["data"])
    want = {None if r["page_id"] is None else str(r["page_id"]): (r["html"] or "").encode() for r in df.collect()}
    last = [r for r in chunks if r["last"]]
    assert len(last) == df.count()
    for r in last:
        data = want[r["id"]]
        assert r["length"] == len(data)
        assert r["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r["type"] == "response":
            assert whole[r["id"]] == data
    revisits = sorted((r["id"] or "", r["refers_id"]) for r in last if r["type"] == "revisit")
    assert revisits == [("", "8"), ("2", "1"), ("2", "1"), ("4", "3")]
    assert max(r["no"] for r in chunks) == -(-1000 // 7)
    assert max(len(r["data"]) for r in chunks) <= 7
    files = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert files.count(b"WARC/1.1\r\n") == len(chunks) and b"WARC-Segment-Total-Length: 1000" in files


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    df = pages(spark).where("page_id is not null").dropDuplicates(["page_id"])
    out = warc.read(spark, warc.archive(df, min_bytes=8, path=str(tmp_path / "b"))).where("last").collect()
    assert {r["id"]: r["type"] for r in out}["4"] == "response"
    assert {r["id"]: r["type"] for r in out}["2"] == "revisit"


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "c"
    warc.archive(pages(spark).where("page_id = 7").coalesce(1), path=str(path))
    name = glob.glob(str(path / "*.gz"))[0]
    data = gzip.open(name).read().replace(b"zzzz", b"zzyz", 1)
    path2 = tmp_path / "d"
    path2.mkdir()
    with gzip.open(path2 / "x.txt.gz", "wb") as f:
        f.write(data)
    try:
        warc.read(spark, str(path2)).collect()
    except Exception as e:  # noqa: BLE001
        assert "does not fit its digest" in str(e)
    else:
        raise AssertionError("not noticed")


def test_empty(spark, tmp_path):
    assert warc.read(spark, warc.archive(pages(spark).limit(0), path=str(tmp_path / "e"))).count() == 0
