"""Ranked lexical search (operator 12): accumulator-limited term-at-a-time.

Every query is ranked over all documents.  Documents are taken in shards of at most
``SHARD`` postings; in a shard a query's terms are worked off rarest first.  A term
adds its share to the accumulators of its documents; new accumulators are made only
while the bounds of the terms still to come can reach the k-th best partial score.
From then on only the documents that have an accumulator are looked up in the
longer lists, so their scores stay exact and everybody else is ruled out by bounds.
The k-th score of a task's earlier shards is a floor for its later ones.

Scale.  The query set is taken in blocks (``BLOCK`` bytes of different query texts in
expectation; a text that many items repeat is searched once), and only a block and
its terms are sent to the workers.  The documents' postings of these terms are
written once to the shared folder, a row per document, never grouped by term: a word in
a third of all documents is spread like the documents are.  A task returns at most k
rows per query; these are ranked within salts and then globally.  Counts (documents
per term, words, documents) are one pre-aggregated pass over the postings.

Scores are whole numbers: w*((1000000000*tf) div (1000*tf+12*m)) summed over the terms of
a query, repeats included, with w = floor(1000*ln((2N+2)/(2df+1))) and
m = 100-25+((25*n*N) div L).

Defined results: a null text has no terms; a document or query without terms takes no part
(the query has no rows); scores above 0 only; ties go to the smaller id, a null id last;
rows that repeat are documents, or items, of their own; empty tables give no rows; very
long texts are one row each in their shard; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrel.llm.common import written

TOP = 20
BLOCK = 8 << 20       # bytes of query texts in a block
SHARD = 1 << 20       # postings that a worker holds at a time
SALTS = 256
TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")   # on UTF-8 bytes; the class has no byte above 7F
NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters, digits and all that is not ASCII; A-Z lower-cased."""
    return TERMS.findall(text.lower())


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` terms, and of the terms of the vocabulary ``at`` (their numbers) and ``tf``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        known = number.keys()
        for batch in batches:
            n, at, tf, ends = [], [], [], [0]
            for text in batch.column(1):
                found = terms(text.as_py() or b"")
                counts = Counter(found)
                for t in counts.keys() & known:
                    at.append(number[t])
                    tf.append(counts[t])
                n.append(len(found))
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["id", "n", "at", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "id long, n long, at array<int>, tf array<long>"), "lex-postings")


class Shard:
    """Postings of some documents, by term; ``share`` is what a term adds before its weight."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, at: np.ndarray, tf: np.ndarray, docs: int, words: int):
        self.ids = ids
        lengths = np.array([75 + 25 * int(x) * docs // words for x in n], np.int64) if words else n
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(at, kind="stable")
        tf = tf[order]
        self.doc = doc[order]
        self.share = 1_000_000_000 * tf // (1000 * tf + 12 * lengths[self.doc])
        self.terms, first = np.unique(at[order], return_index=True)
        self.first = np.append(first, len(at))
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.most = np.maximum.reduceat(self.share, first) if len(at) else self.share

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at most k documents, best first; ``query``: (term, weight with its
        repeats), rarest first; documents below ``floor`` may be left out."""
        lists = [(self.place[t], w) for t, w in query if t in self.place and w > 0]
        bounds = np.array([w * int(self.most[i]) for i, w in lists], np.int64)
        to_come = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        score = np.zeros(len(self.ids), np.int64)
        alive = None
        for j, (i, w) in enumerate(lists):
            a, b = self.first[i], self.first[i + 1]
            if alive is None:
                partial = score[score > 0]
                reached = int(np.partition(partial, len(partial) - k)[len(partial) - k]) if len(partial) >= k else 0
                reached = max(reached, floor)
                if to_come[j] < reached:   # no new accumulators; those that cannot reach it go too
                    alive = np.flatnonzero((score > 0) & (score + to_come[j] >= reached))
            if alive is None:
                score[self.doc[a:b]] += w * self.share[a:b]
            elif len(alive):
                here = np.searchsorted(self.doc[a:b], alive)
                here[here == b - a] = 0
                hit = self.doc[a:b][here] == alive
                score[alive[hit]] += w * self.share[a:b][here[hit]]
        found = np.flatnonzero(score > 0) if alive is None else alive
        order = np.lexsort((self.ids[found], -score[found]))[:k]
        return self.ids[found[order]], score[found[order]]


def _block(docs: DataFrame, texts: list[tuple[bytes, str]], k: int, id_col: str, text_col: str) -> DataFrame:
    """``key, id, score``: the best k of every query text of a block, ``texts``: (key, text)."""
    spark = docs.sparkSession
    queries = [(key, Counter(terms((text or "").encode()))) for key, text in texts]
    number = {t: i for i, t in enumerate(sorted({t for _, c in queries for t in c}))}
    index = postings(docs, spark.sparkContext.broadcast(number), id_col, text_col)
    total = index.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("docs"), F.sum("n").alias("words")).first()
    n_docs, words = int(total["docs"] or 0), int(total["words"] or 0)
    df = {r["t"]: r["count"] for r in index.select(F.explode("at").alias("t")).groupBy("t").count().collect()}  # terms of the block

    def weight(t: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))

    plan = spark.sparkContext.broadcast(
        [(key, [(t, weight(t) * times) for t, times in sorted(((number[t], m) for t, m in c.items() if number[t] in df),
                                                              key=lambda q: (df[q[0]], q[0]))]) for key, c in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            ids, lists = rows.column("id").combine_chunks(), rows.column("at").combine_chunks()
            shard = Shard(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), rows.column("n").to_numpy(),
                          np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), lists.flatten().to_numpy(),
                          rows.column("tf").combine_chunks().flatten().to_numpy(), n_docs, words)
            for q, (_, query) in enumerate(plan.value):
                old = best.get(q)
                floor = int(old[1][-1]) if old is not None and len(old[1]) == k else 0
                ids, scores = shard.search(query, k, floor)
                if old is not None:
                    ids, scores = np.append(old[0], ids), np.append(old[1], scores)
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                best[q] = ids, scores

        held, size = [], 0
        for batch in batches:
            counts = np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(counts, (counts[a - 1] if a else 0) + SHARD - size, "right")))
                held.append(batch.slice(a, b - a))
                size += int(counts[b - 1] - (counts[a - 1] if a else 0))
                a = b
                if size >= SHARD or a < batch.num_rows:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        for q, (ids, scores) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([plan.value[q][0]] * len(ids), pa.binary()),
                     pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], names=["key", "id", "score"])

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("key", *by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = index.where(F.size("at") > 0).mapInArrow(run, "key binary, id long, score long")
    return ranked(ranked(found.withColumn("salt", F.spark_partition_id() % SALTS), "salt"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, id, score``: of every row of ``items`` the ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    texts = rows.select(F.unhex(F.sha2("text", 256)).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    out = None
    for b in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()   # BLOCK bytes in expectation
        part = _block(docs, [(bytes(r["key"]), r["text"]) for r in block], k, id_col, text_col)
        part = written(part, "lex-top") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return (rows.select("item", F.unhex(F.sha2("text", 256)).alias("key")).join(out, "key")
            .select("item", F.col("rank").cast("int").alias("rank"), "id", "score"))
