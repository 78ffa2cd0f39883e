"""Exact dedup (operator 4): skew-safe combining.

Three combining steps, each comparing the full normalised text next to its
digest (both are grouping keys, so two texts that share a digest stay apart):

1. local: the map side of the first grouping leaves one row per text, salt and
   task, however many copies a task reads;
2. salted: the groups of ``(digest, text, salt)`` meet, so the copies of one
   text are merged by up to ``salts`` tasks;
3. global: at most ``salts`` winners of a text are combined.

Texts travel only in steps 1 and 2; the decision returns to the documents by
the digest alone (narrow rows), after the comparison has shown that the digest
has one text; if two texts ever shared a SHA-256 digest, the job fails with a
message instead of merging them.  Copies of one text may be a third of all
rows: that last join is an ordinary shuffle join of narrow rows which adaptive
execution may split.

Defined results: null text is empty.  A null id sorts after all others.  Rows
that repeat an id and a text are copies of each other, and one of them stays.  An empty
table gives no rows; other columns are ignored, whatever their names; a long text is
one row, compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column | str) -> Column:
    """Text with each run of ASCII white space as one space; null is empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " ")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``digest`` (SHA-256 of the normalised text, binary)."""
    norm = normalised(text_col)
    rows = (docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
            .select("id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"),
                    F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id")))
    salted = rows.groupBy("digest", "norm", "salt").agg(first.alias("first"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    found = groups.groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    one = found.select("digest", "n", F.when(F.col("texts") == 1, F.col("first.id")).otherwise(
        F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("keep_id"))
    # rows that repeat id and text: counted, then numbered when they are spread out again
    members = (rows.groupBy("digest", "id").agg(F.count("*").alias("copies")))
    out = members.join(one, "digest")
    return (out.select("id", "digest", "keep_id", F.col("n").alias("group_size"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"))
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "digest"))
