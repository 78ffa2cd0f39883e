"""Snapshots and change detection.

A snapshot is one row per (url, snapshot_ts) holding the compared parts of
the full record.  Comparing two snapshot sets is a join on ``url`` plus
``array_except`` both ways per field (set differences), so the change set is
produced without any per-URL driver loop.  Latest-per-URL is ``max_by`` (an
aggregate with map-side combine, safe for a URL with many snapshots).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.functions import urls as U
from webrel.operators import business as B
from webrel.operators import dom as D
from webrel.operators import record as RC
from webrel.session import written
from webrel.sources.store import SnapshotStore


def _empty():
    return F.array().cast("array<string>")
WORD_DELTA = 50  # fixed value: word-count change must exceed this


def snapshot_records(dom: D.Dom, pages: DataFrame, ts_col: str = "snapshot_ts",
                     with_prices: bool = True) -> DataFrame:
    """M03 payload: url, ts, title, headings, links, images, prices, full_text,
    hash.  ``hash`` = md5(full_text) or, for empty text, md5 of the record's
    JSON without snapshot metadata (decision Q5)."""
    headings = lambda p: F.filter(F.transform(RC.tagged(p, "h1", "h2", "h3", "h4"), lambda e: TX.strip_join(p.deep(e))), lambda t: t != "")
    parts = {"title": RC.title, "headings": headings, "links": lambda p: F.transform(RC.links(p), lambda a: a["href"]),
             "images": lambda p: F.transform(RC.images(p), lambda i: i["src"]), "full_text": RC.full_text}
    if with_prices:
        parts["prices"] = lambda p: F.flatten(F.transform(B.pricing(p), lambda r: r["prices_found"]))
    # a record is far larger than the row its page is made from, by which Spark would judge whether to broadcast it
    rec = pages.select("page_id", "url", F.col(ts_col).alias("snapshot_ts")).join(RC.parts(dom, **parts).hint("merge"), "page_id", "left")
    rec = rec.withColumn("prices", F.col("prices") if with_prices else _empty())
    rec = rec.select("page_id", "url", "snapshot_ts", F.coalesce("title", F.lit("")).alias("title"),
                     *[F.coalesce(c, _empty()).alias(c) for c in ("headings", "links", "images", "prices")],
                     F.coalesce("full_text", F.lit("")).alias("full_text"))
    body = F.to_json(F.struct("title", "headings", "links", "images", "prices", "full_text"))
    rec = rec.withColumn("hash", F.md5(F.when(F.col("full_text") != "", F.col("full_text")).otherwise(body)))
    # snapshots are a stored table: written once to the shared checkpoint folder,
    # which also ends the DOM lineage
    return written(rec, "snapshots")


def latest(snapshots: DataFrame, key: str = "url") -> DataFrame:
    """The newest snapshot per key."""
    cols = [c for c in snapshots.columns if c != key]
    order = F.struct("snapshot_ts", "page_id") if "page_id" in cols else F.col("snapshot_ts")
    return (snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_s"),
                                       F.count("*").alias("n_snapshots"))
            .select(key, "_s.*", "n_snapshots"))


def compare(old: DataFrame, new: DataFrame, deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status per url, change rows).

    One pass over ``new LEFT JOIN old``: every change type is an array of
    change structs, concatenated and exploded once.  status: first_snapshot
    (no old) / no_change (equal hash; with ``deep`` only when there is also no
    change) / changed / minor_change.
    """
    o = old.select("url", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "url"])
    return _compare_rows(new.join(o, "url", "left"), deep)


def _compare_rows(j: DataFrame, deep: bool) -> tuple[DataFrame, DataFrame]:
    """``compare`` where every new snapshot carries the old one as ``o_*`` columns."""
    has_old = F.col("o_hash").isNotNull()
    same = F.col("hash") == F.col("o_hash")
    active = has_old if deep else (has_old & ~same)
    null_s = F.lit(None).cast("string")
    null_i = F.lit(None).cast("int")

    def ch(typ, old_v=null_s, new_v=null_s, value=null_s, wd=null_i, ow=null_i, nw=null_i):
        return F.struct(F.lit(typ).alias("type"), old_v.alias("old"), new_v.alias("new"), value.alias("value"),
                        wd.alias("word_diff"), ow.alias("old_words"), nw.alias("new_words"))

    def setdiff(field, added, removed):
        return [F.transform(F.array_except(F.col(field), F.col(f"o_{field}")), lambda v: ch(added, value=v)),
                F.transform(F.array_except(F.col(f"o_{field}"), F.col(field)), lambda v: ch(removed, value=v))]

    ow, nw = TX.word_count(F.col("o_full_text")), TX.word_count(F.col("full_text"))
    wd = nw - ow
    parts = [F.when(~F.col("title").eqNullSafe(F.col("o_title")),
                    F.array(ch("title_changed", F.col("o_title"), F.col("title"))))]
    for f, a, r in (("headings", "heading_added", "heading_removed"), ("links", "link_added", "link_removed"),
                    ("images", "image_added", "image_removed"), ("prices", "price_added", "price_removed")):
        parts += setdiff(f, a, r)
    parts.append(F.when(F.abs(wd) > WORD_DELTA, F.array(ch("content_changed", wd=wd, ow=ow, nw=nw))))
    empty = F.array().cast("array<struct<type:string,old:string,new:string,value:string,"
                           "word_diff:int,old_words:int,new_words:int>>")
    all_changes = F.when(active, F.concat(*[F.coalesce(p, empty) for p in parts])).otherwise(empty)
    j = j.withColumn("_ch", all_changes)
    n = F.size("_ch")
    status = (F.when(~has_old, F.lit("first_snapshot"))
              .when(same & ((n == 0) | F.lit(not deep)), F.lit("no_change"))
              .when(n > 0, F.lit("changed")).otherwise(F.lit("minor_change")))
    st = j.select("url", status.alias("status"), F.col("o_snapshot_ts").alias("last_snapshot"),
                  n.alias("n_changes"))
    changes = j.select("url", F.explode("_ch").alias("c")).select("url", "c.*")
    return st, changes


def list_snapshots(snapshots: DataFrame, url: str | None = None) -> DataFrame:
    """Newest first: slug file name, url, timestamp, first 8 hash chars."""
    s = snapshots if url is None else snapshots.filter(F.col("url") == url)
    file = F.concat(U.snapshot_slug(F.col("url")), F.lit("__"), F.date_format("snapshot_ts", "yyyyMMdd_HHmmss"),
                    F.lit(".json"))
    return s.select(file.alias("file"), "url", "snapshot_ts", F.substring("hash", 1, 8).alias("hash")) \
        .orderBy(F.col("snapshot_ts").desc(), "url")


def diff_report(changes: DataFrame) -> DataFrame:
    """One line per change: ``k: v | k: v`` of the non-type fields, <= 200."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
             for c in ("old", "new", "value", "word_diff", "old_words", "new_words")]
    return changes.select("url", "type", TX.cut(F.concat_ws(" | ", *parts), 200).alias("detail"))


def stored_snapshots(spark: SparkSession, store_path: str) -> DataFrame | None:
    """All snapshots of a store; None if there is none yet.  A store that cannot be read is an error."""
    return SnapshotStore(spark, store_path).history()


def monitor_batch(captures: DataFrame, store_path: str, out_path: str, deep: bool = False,
                  batch_id: int | str | None = None) -> None:
    """P03 / M15 body: compare every captured page with the snapshot before it (an
    earlier capture of the batch, else the latest stored one), write status and
    change rows and add the snapshots to the store.

    Status and changes go to folders of the batch, which a repeated batch overwrites; the
    store takes its rows once.  A repeated batch is compared with the store as it was
    before it, so it leaves the same files.  Without ``batch_id`` the call is a batch of
    its own.  What a batch reads is the latest snapshot per url, never the history."""
    spark = captures.sparkSession
    batch = uuid.uuid4().hex if batch_id is None else str(batch_id)
    store = SnapshotStore(spark, store_path)
    base = store.before(batch)
    new = snapshot_records(D.parse(captures), captures)
    cols = new.columns
    rest = [c for c in cols if c != "url"]
    w = Window.partitionBy("url").orderBy("snapshot_ts", "page_id")   # the captures of one url in a batch
    j = store.join_latest(new, base).withColumn("_before", F.lag(F.struct(*rest)).over(w))
    old = F.struct(*[F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(
        F.col(f"_old.{c}")).alias(c) for c in rest])
    j = j.withColumn("_o", old).select(*cols, *[F.col(f"_o.{c}").alias(f"o_{c}") for c in rest])
    status, changes = _compare_rows(j, deep)
    status.write.mode("overwrite").parquet(f"{out_path}/status/batch={batch}")
    changes.write.mode("overwrite").parquet(f"{out_path}/changes/batch={batch}")
    store.append(new, batch)
    store.expire()
