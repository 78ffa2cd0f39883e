"""Line dedup (operator 8): deletion-neighbourhood join, DataFrame functions only.

A line is a duplicate if an earlier line lies within the edit bound: equal text,
or one word inserted, deleted or replaced where both have at least ``min_words``
words.  Earlier means a smaller (document, line number); the earliest occurrence
stays, every duplicate is removed from its document.  Lines are split at ``\\n``;
the words of a line are what stands between single spaces, so two spaces hold an
empty word.

Deletion neighbourhood.  Two lines are within one edit if and only if they share
a variant with at most one word deleted: ``x`` and ``y`` of equal length share the
variant that lacks word ``i`` of both, and of ``x`` and the longer ``y`` the whole of
``x`` is a variant of ``y``.  Every word is hashed with its position; the hash of a
variant is the exclusive-or of its words' hashes, with the words after the gap
moved up by one, so all variants of a line come from running sums over its words.
Variants are keys of 16 bytes; equal keys are joined by grouped minima (each key
names its earliest line), never as pairs, and the words of every match are
compared again before a line is removed.

Which lines emit variants.  Lines within one edit agree in the first or in the
last half of their words.  Every line emits those halves as four narrow keys; a
line that shares none with a different line cannot have a partner and emits no
variants.  This drops nothing: it holds for every pair within the bound.

Scale.  Occurrences travel as hashes, and where only few can match a bit table of
bounded size (``maybe_in``) holds the others back before the exact join, so
texts move once, when the lines are removed.  A line that fills a third of all rows is merged before it is shuffled, and
returns to its occurrences in a join which adaptive execution may split.

Defined results: null text is empty and has no lines; empty and blank lines are
kept and never duplicates; a null id comes after all others; rows that repeat id
and text are one document and all get its result; an empty table gives no rows; a
long text is one row with all its lines; other columns come along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrel.llm.common import maybe_in, partitions, row_key, written

MIN_WORDS = 8


def _occurrences(text: DataFrame) -> DataFrame:
    """``rid, id, no, line`` of every line that is not blank."""
    lines = text.select("rid", "id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where(F.trim("line") != "")


def _key(line) -> Column:
    """16 bytes that name a line."""
    return F.unhex(F.md5(line))


def _candidates(occ: DataFrame, min_words: int) -> DataFrame:
    """``k``: hash of the lines that agree with a different line in half of their words.

    A line of ``n`` words emits the halves of a pair whose shorter line has ``n`` or
    ``n - 1`` words: together three, since two of them always have equal lengths."""
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    rows = occ.select("line", F.xxhash64("line").alias("k"), n.alias("n")).where(F.col("n") >= min_words)
    rows = rows.withColumn("a", F.expr("n div 2").cast("int"))
    first = lambda a: F.xxhash64(F.lit("first"), a, F.call_function("substring_index", F.col("line"), F.lit(" "), a))
    last = lambda a: F.xxhash64(F.lit("last"), a, F.call_function("substring_index", F.col("line"), F.lit(" "), -a))
    slots = rows.select("k", F.explode(F.array(
        first(F.col("a")), last(F.col("n") - F.col("a")),
        F.when(F.col("n") % 2 == 0, first(F.col("a") - 1)).otherwise(last(F.col("a"))))).alias("half"))
    shared = written(slots.groupBy("half").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("half"), "halves")
    return maybe_in(slots, F.col("half"), shared, F.col("half")).join(shared, "half").select("k").distinct()


def _variants(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, at, n, words`` -> one row per variant: the words' number and two hashes
    of the line without word ``gap`` (0: the whole line)."""
    by = Window.partitionBy("key")
    upto = by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = lines.select("key", "at", "n", F.posexplode("words").alias("p", "w")).withColumn("i", F.col("p") + 1)
    for s in ("1", "2"):
        words = (words.withColumn("h" + s, F.xxhash64(F.lit(int(s)), "w", "i")).withColumn("m" + s, F.xxhash64(F.lit(int(s)), "w", "p"))
                 .withColumn("before" + s, F.bit_xor("h" + s).over(upto)).withColumn("moved" + s, F.bit_xor("m" + s).over(upto))
                 .withColumn("all" + s, F.bit_xor("m" + s).over(by)))
    x = lambda a, b: a.bitwiseXOR(b)
    c = F.col
    gap = words.select("key", "at", (c("n") - 1).alias("size"), c("i").alias("gap"), *[
        x(x(c("before" + s), c("h" + s)), x(c("all" + s), c("moved" + s))).alias("v" + s) for s in ("1", "2")])
    whole = words.where("i = n").select("key", "at", c("n").alias("size"), F.lit(0).alias("gap"), c("before1").alias("v1"), c("before2").alias("v2"))
    return gap, whole


def _near(lines: DataFrame) -> DataFrame:
    """``key``s of the lines that have an earlier line within one edit."""
    gap, whole = _variants(lines)
    g = ["size", "v1", "v2"]
    me = F.struct("at", "key", "gap")
    rows = written(gap.unionByName(whole), "line-variants")
    # a key of one line only joins nothing
    busy = rows.groupBy(*g).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select(*g)
    rows = written(rows.join(busy, g), "line-matches")
    replaced = rows.where("gap > 0").groupBy(*g, "gap").agg(F.min(me).alias("p"))
    longer = rows.where("gap > 0").groupBy(*g).agg(F.min(me).alias("p"))
    entire = rows.where("gap = 0").groupBy(*g).agg(F.min(me).alias("p"))
    found = (rows.where("gap > 0").join(replaced, [*g, "gap"])
             .unionByName(rows.where("gap = 0").join(longer, g)).unionByName(rows.where("gap > 0").join(entire, g)))
    found = found.where(F.col("p.at") < F.col("at")).select("key", "gap", F.col("p.key").alias("other"), F.col("p.gap").alias("other_gap"))
    words = lines.select("key", "words")
    pairs = (found.distinct().join(words, "key")
             .join(words.select(F.col("key").alias("other"), F.col("words").alias("other_words")), "other"))

    def without(w: str, i: str) -> Column:
        return F.when(F.col(i) == 0, F.col(w)).otherwise(F.concat(
            F.slice(w, F.lit(1), F.col(i) - 1), F.slice(w, F.col(i) + 1, F.greatest(F.size(w) - F.col(i), F.lit(0)))))

    return pairs.where(without("words", "gap") == without("other_words", "other_gap")).select("key").distinct()


def duplicates(text: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``rid, id, text`` -> ``rid, gone``: numbers (from 0) of the lines to remove."""
    occ = _occurrences(text)
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("rid").alias("rid"), F.col("no").alias("no"))
    candidates = written(_candidates(occ, min_words), "line-candidates")
    seen = occ.select("rid", "id", "no", _key("line").alias("key"), F.xxhash64("line").alias("k"))
    times = seen.groupBy("key", "k").agg(F.min(place).alias("at"), F.count("*").alias("times"))
    near = candidates.withColumn("candidate", F.lit(True))
    known = written(times.join(near, "k", "left").where("times > 1 or candidate")
                    .select("key", "at", "times", F.coalesce("candidate", F.lit(False)).alias("candidate")), "lines")
    wanted = known.where("candidate").select(F.col("at.rid").alias("rid"), F.col("at.no").alias("no"), "key", "at")
    at = F.xxhash64("rid", "no")
    fetched = (maybe_in(occ.select("rid", "no", "line"), at, wanted, at).join(wanted, ["rid", "no"])
               .select("key", "at", "line").dropDuplicates(["key"]))
    lines = written(fetched.select("key", "at", F.split("line", " ", -1).alias("words")).withColumn("n", F.size("words")), "line-words")
    near = _near(lines.repartition(partitions(text.sparkSession), "key")).withColumn("near", F.lit(True))
    dropped = written(known.join(near, "key", "left").where("times > 1 or near")
                      .select("key", "at", F.coalesce("near", F.lit(False)).alias("near")), "line-drops")
    first = (F.col("at.rid") == F.col("rid")) & (F.col("at.no") == F.col("no"))
    hits = maybe_in(occ.select("rid", "no", _key("line").alias("key")), F.col("key"), dropped, F.col("key"))
    return (hits.join(dropped, "key").where(F.col("near") | ~first)
            .groupBy("rid").agg(F.collect_set("no").alias("gone")))   # at most the lines of one document


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``row`` (the input row as a struct), ``text`` (null stays
    null), ``n_lines``, ``n_removed``."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col),
                       F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = duplicates(rows.select("rid", "id", "text"), min_words)
    out = rows.select("rid", "row").join(gone, "rid", "left")
    lines = F.split(F.col("row")[text_col], "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    out = out.withColumn("lines", lines)
    return out.select(
        "row", F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(
            F.array_join(F.transform(keep, lambda i: F.element_at("lines", i + 1)), "\n")).alias("text"),
        F.coalesce(F.when(F.col("row")[text_col] != "", F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the duplicate lines removed from the texts; same columns."""
    out = dedup(docs, id_col, text_col, min_words)
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
