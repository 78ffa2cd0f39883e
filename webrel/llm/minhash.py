"""MinHash near-dedup (operator 6): ProbMinHash over sets of word shingles.

Every distinct shingle of five words (a text of fewer is one shingle) generates the
points of a Poisson process with the rate of its weight, from its hash alone:
exponential waiting times, each point falling on a random register.  A register
keeps the shingle that arrives first; a shingle stops as soon as its next point is
later than every register's arrival, so most stop after one point.  Two texts
agree in a register with the probability Jaccard of their weights.  A link is
defined by the sets, so every shingle weighs 1, however often its text repeats it,
and two texts agree in a register with the Jaccard similarity of their sets.
``BANDS`` bands of ``ROWS`` registers give the candidates, and every link is
verified by the exact Jaccard similarity of the shingle sets.

Classes without all pairs.  Texts with equal words are one node.  In each bucket
every node is compared with the bucket's smallest node only (a star), and the
links that hold are joined into components.  What is left are buckets with nodes of
several components.  A node there can have a further link only if no more than a
fifth of its shingles are its own (``_may_link``), which rules out most of a family
of loose copies at once; the others are compared across components, so no link
that banding finds is lost.  Counting and joining are by bucket key with partial
combining: a bucket with a third of all texts costs one row per text.

Missed links: a pair of similarity 0.8 shares no band with probability
``(1 - 0.8**4)**24`` = 3e-6, also where passages repeat inside a text.

Defined results: words are separated by white space and compared in lower case;
null, empty and blank texts have no words, and are equal texts; a null id sorts
last; rows that repeat id and text are copies; an empty table gives no rows; a long
text is one set of all its shingles; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrel.llm.common import maybe_in, row_key, written
from webrel.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
STARS = 2            # rounds of stars before components are compared with each other
CACHE = 500_000      # word hashes remembered by one Python worker

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, {}

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes (sorted) and their counts."""
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        for w in set(tokens):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        h = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
        for k in range(n):
            out = _mix(out + h[k:len(h) - n + 1 + k])
        return np.unique(out, return_counts=True)


def signature(shingles: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash: the shingle that arrives first at each register."""
    first = np.full(registers, np.inf)
    holder = np.zeros(registers, np.uint64)
    time, rate, h, step = np.zeros(len(shingles)), weights.astype(float), shingles, 0
    while len(h):
        step += 1
        r = _mix(h + _U(0x9E3779B97F4A7C15 * 2 * step & (1 << 64) - 1))
        u = (_mix(h ^ _mix(r)) >> _U(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-u) / rate          # the next point of each shingle
        at = (r % _U(registers)).astype(np.int64)
        before = first.copy()
        np.minimum.at(first, at, time)
        won = (time == first[at]) & (time < before[at])
        holder[at[won]] = h[won]
        active = time < first.max()                # later points cannot arrive first anywhere
        time, rate, h = time[active], rate[active], h[active]
    return holder


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            content, keys = [], []
            for text in batch.column("text"):
                tokens = (text.as_py() or "").lower().split()
                content.append(hashlib.md5(" ".join(tokens).encode("utf-8", "replace")).digest())
                if not tokens:
                    keys.append([])
                    continue
                s, _ = shingle(tokens)
                sig = signature(s, np.ones(len(s)), bands * rows).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    key = _mix(key + sig[:, k])
                keys.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["rid", "id", "content", "keys"])

    return run


def _bits(shingles: np.ndarray) -> list[int]:
    """One bit per shingle in a table of 4 to 8 bits per shingle, a power of two of words."""
    words = 1 << max(2, int(len(shingles) * 4 - 1 >> 6).bit_length())
    out = np.zeros(words, np.uint64)
    at = shingles & _U(words * 64 - 1)
    np.bitwise_or.at(out, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out.view(np.int64).tolist()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle((t.as_py() or "").lower().split())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                 pa.array([_bits(x) for x in sets], pa.list_(pa.int64()))], ["content", "shingles", "bits"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)`` -> + exact Jaccard similarity ``sim``."""
    one = pairs.join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("y")), "b")
    both = one.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("sim"))


def _may_link(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes that can still have a link to another of ``nodes``, with the ``size``
    of their set and how many of its shingles are theirs ``alone``.

    A link of similarity s leaves at most ``(1 - s)`` of a set outside its partner, so
    a node with more shingles than that which no other node has is out.  Nothing
    with a link is lost."""
    mine = sets.join(nodes, "content")   # content, shingles, bits
    alone = (mine.select("content", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("content").alias("content"))
             .where("n = 1").groupBy("content").agg(F.count("*").alias("alone")))
    sized = mine.select("content", F.size("shingles").alias("size"), "bits").join(alone, "content", "left").na.fill(0, ["alone"])
    return sized.where(F.col("alone") <= (1 - similarity) * F.col("size") + 1e-9)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``rid``, ``id``, ``class_id`` (smallest id of the class),
    ``class_rid`` (its row), ``class_size``."""
    id_type = dict(docs.dtypes)[id_col]
    text = docs.select(row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = written(text.mapInArrow(_sketch(words, bands, rows), f"rid binary, id {id_type}, content binary, keys array<long>"),
                     "sketches")
    nodes = sketch.groupBy("content").agg(F.min("rid").alias("rid"), F.first("keys").alias("keys"))
    slots = nodes.select("content", F.explode("keys").alias("key"))
    shared = written(slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    members = written(maybe_in(slots, F.col("key"), shared, F.col("key")).join(shared, "key").select("key", F.col("content").alias("b"), "n"), "buckets")
    wanted = members.select(F.col("b").alias("content")).distinct().join(sketch.groupBy("content").agg(F.min("rid").alias("rid")), "content")
    wanted = written(wanted, "candidates")
    near = maybe_in(text.select("rid", "text"), F.col("rid"), wanted, F.col("rid")).join(wanted, "rid").dropDuplicates(["rid"])
    sets = written(near.select("content", "text").mapInArrow(_sets(words), "content binary, shingles array<long>, bits array<long>"), "shingles")

    # stars: the members of each bucket against its most central node, the one that
    # shares the most places in buckets; again for those left outside its component
    left, tested, label = members, None, None
    for _ in range(STARS):
        central = left.groupBy("b").agg(F.sum("n").alias("c"))
        heads = left.join(central, "b").groupBy("key").agg(F.max(F.struct("c", "b")).alias("head")).select("key", F.col("head.b").alias("a"))
        star = left.join(heads, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            star = star.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_verify(star, sets), "pairs")
        tested = new if tested is None else tested.unionByName(new)
        label = components(tested.where(F.col("sim") >= similarity).select("a", "b"))
        of = label.select(F.col("node").alias("b"), "label")
        now = members.select("key", "b", "n").join(of, "b", "left").withColumn("label", F.coalesce("label", "b"))
        biggest = now.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(
            F.count("*").alias("labels"), F.max(F.struct("k", "label")).alias("m")).where("labels > 1").select("key", F.col("m.label").alias("main"))
        now = written(now.join(biggest, "key"), "buckets")   # buckets with several components
        left = now.where("label <> main").select("key", "b", "n")
    left = now.select("key", "b", "label")

    def mixed(m: DataFrame) -> DataFrame:
        keys = m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        return m.join(keys, "key", "left_semi")

    live = _may_link(left.select(F.col("b").alias("content")).distinct(), sets, similarity)
    left = written(mixed(left.join(live.withColumnRenamed("content", "b"), "b")), "buckets")
    x, y, c = left.alias("x"), left.alias("y"), F.col
    # A bit that x has and y lacks is a shingle that x has and y lacks, and what a node
    # has alone is in no other: both bound the similarity of two nodes from above.
    def lacks(p, q):
        missing = F.aggregate(F.zip_with(p, q, lambda m, n: F.bit_count(m.bitwiseAND(F.bitwise_not(n)))), F.lit(0), lambda t, k: t + k)
        return F.when(F.size(p) == F.size(q), missing).otherwise(0)

    most = F.least(c("x.size") - F.greatest(c("x.alone"), lacks(c("x.bits"), c("y.bits"))),
                   c("y.size") - F.greatest(c("y.alone"), lacks(c("y.bits"), c("x.bits"))))
    apart = x.join(y, (c("x.key") == c("y.key")) & (c("x.b") < c("y.b")) & (c("x.label") != c("y.label"))
                   & (most >= similarity * (c("x.size") + c("y.size") - most) - 1e-9))
    apart = apart.select(c("x.b").alias("a"), c("y.b").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = written(_verify(apart, sets), "pairs").where(F.col("sim") >= similarity).select("a", "b")
    if not more.isEmpty():
        label = components(label.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(more))

    out = sketch.select("rid", "id", "content").join(label.withColumnRenamed("node", "content"), "content", "left")
    out = out.select("rid", "id", F.coalesce("label", "content").alias("label"))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    of_class = out.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
    return out.join(of_class, "label").select("rid", "id", F.col("first.id").alias("class_id"), F.col("first.rid").alias("class_rid"), "class_size")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id (of rows
    that repeat id and text, the smallest row); same columns."""
    kept = classes(docs, id_col, text_col, **how).select(F.col("class_rid").alias("rid")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col))
    return rows.join(kept, "rid").groupBy("rid").agg(F.min("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
