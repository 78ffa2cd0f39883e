"""Mixing sources to target weights (operator 3): weighted fair queueing.

Every source is a queue.  Its documents are shuffled by a hash of their id; a
copy of a document gets the virtual finish time

    (words of its source up to and including it) / (target of its source)

where the second and third copy of a document follow after the whole source.
Sorting all copies by finish time serves each source in proportion to its
target; the order is cut where the words taken reach the budget, the sum of all
targets (= all words).

Scale.  No source is ordered by one task: the hash order is cut into equal
ranges (buckets), a window runs inside ``(source, bucket)`` and the sums of the
ranges before it are added from a table of one row per source and bucket.  The
global order by finish time is treated alike: a histogram over ranges of finish
times finds the range that holds the budget's end, only that range is sorted,
and the key of the last copy taken (one row) decides every other row by a
comparison, without a join or another shuffle.  Both numbers of ranges follow
the number of rows.  The sized rows are written once to the shared folder.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating.  They
share all words; a target stops at ``cap`` times its source and the excess is
shared by weight among the rest, which is the water level found from the sorted
ratios of size and weight (a table of one row per source).

Defined results: null text has 0 words; documents of 0 words are never taken; a
null source is a source of its own; rows that repeat id and text share one place
in the order, so they are taken alike; an empty table gives no rows; a long text counts with all its
words; other columns come along unchanged.  The order depends on ids and texts only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrel.llm.common import row_key, written

WEIGHTS = (5, 2, 1)
CAP = 3
WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 50_000


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> plus ``target``.  One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    w = sizes.withColumn("place", place).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    before = Window.orderBy(F.col("source_size") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(all_rows) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / F.nullif(F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), F.lit(0.0)))
    lev = w.withColumn("level", level)
    full = F.col("source_size") * float(cap) <= F.col("level") * F.col("w")
    lev = lev.withColumn("full", full)
    water = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "place", "level"))).over(all_rows)
    return lev.select("source", "source_size", F.col("place").alias("place"),
                      F.when(F.col("full"), F.col("source_size") * float(cap))
                      .otherwise(water["level"] * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cap: int = CAP, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row per document: ``rid`` (see ``row_key``), ``id``, ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` (times it is taken, 0 to ``cap``)."""
    n_rows = docs.count()
    ranges = max(1024, n_rows // ROWS_PER_RANGE)
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = (docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                         F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
                         h.alias("h"), row_key(id_col, text_col))
             .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("int")))
    sized = written(sized, "mix-sizes")
    per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("words_before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)
    per = per.join(goal, per["source"].eqNullSafe(goal["source"])).select(
        per["source"], "bucket", "words_before", "source_size", "target", "place")
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("id").asc_nulls_last(), "rid").rangeBetween(
        Window.unboundedPreceding, 0)
    queue = sized.withColumn("upto", F.sum("size").over(inside))
    queue = (queue.join(per, queue["source"].eqNullSafe(per["source"]) & (queue["bucket"] == per["bucket"]))
             .select("rid", "id", queue["source"], "size", "h", "source_size", "target", "place",
                     (F.col("words_before") + F.col("upto")).alias("upto")))
    queue = written(queue, "mix-queue")

    def finish(e):
        return (e * F.col("source_size") + F.col("upto")) / F.nullif(F.col("target"), F.lit(0.0))

    copies = queue.where("size > 0").select(
        "place", "h", "id", "rid", "size", "source_size", "target", "upto",
        F.explode(F.array(*[F.lit(e) for e in range(cap)])).alias("e")).withColumn("finish", finish(F.col("e")))
    slot = F.least(F.floor(F.col("finish") * ranges), F.lit(8 * ranges)).cast("long")
    by_slot = copies.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    budget = sized.agg(F.sum("size")).first()[0] or 0
    cut = (by_slot.withColumn("upto", F.sum("words").over(so_far)).where(F.col("upto") > budget)
           .orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("before")).head())
    if cut is None:  # every copy fits
        taken = [F.col("size") > 0 for _ in range(cap)]
    else:
        order = ["finish", "place", "h", "rid"]
        edge = (copies.where(slot == cut["slot"])
                .withColumn("upto", F.sum("size").over(Window.orderBy(*order, "e").rangeBetween(Window.unboundedPreceding, 0)))
                .where(F.col("upto") + cut["before"] <= budget).orderBy(*[F.desc(c) for c in order]).select(*order).head())
        last = (F.struct(*[F.lit(bytes(edge[c]) if c == "rid" else edge[c]) for c in order]) if edge else None)
        taken = []
        for e in range(cap):
            f = finish(F.lit(e))
            key = F.struct(f.alias("finish"), F.col("place"), F.col("h"), F.col("rid"))
            here = F.least(F.floor(f * ranges), F.lit(8 * ranges)).cast("long")
            at_edge = (key <= last) if last is not None else F.lit(False)
            taken.append((F.col("size") > 0) & ((here < cut["slot"]) | ((here == cut["slot"]) & at_edge)))
    n = sum((F.when(t, 1).otherwise(0) for t in taken[1:]), F.when(taken[0], 1).otherwise(0))
    return queue.select("rid", "id", "source", "size", "source_size", "target", n.cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          cap: int = CAP, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    took = mix(docs, id_col, text_col, source_col, cap, weights, seed).where("copies > 0").select("rid", "source", "copies").distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col))
    out = (rows.join(took, (rows["rid"] == took["rid"]) & rows["row"][source_col].eqNullSafe(took["source"]))
           .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
