"""Suffix-array dedup (operator 2): depth-limited radix sort of suffixes.

Every byte position is a suffix, ordered by its first ``length`` bytes only; equal
groups are the repeated windows.  The order is built by most-significant-digit
passes, and a group of one leaves the sort as soon as a pass has isolated it.

Digits.  The order among unequal windows does not matter, so the digits are chosen
to split early and to travel as few rows:

1. The first digit of a window is its smallest ``GRAM``-byte group by hash (leftmost
   on ties) and the place of that group, its anchor.  Equal windows have equal
   anchors.  Consecutive windows that share an anchor are one row (a run), on
   average one for 200 bytes.  Groups of one run drop out here.
2. The second digit is the whole run.  Runs that occur at least twice are repeated
   in full, and go on only once, as one representative.
3. Where runs of one group differ, aligned blocks of windows and then single
   windows are the digits.  A block's *core* is what all its windows share: blocks
   alone in their core drop out, blocks that are equal throughout are repeated,
   and only the rest goes on to the next pass.  Groups of up to ``LOCAL`` different
   runs are sorted to the end inside one task, larger groups by passes of
   distributed rows: a passage that a third of all documents quote is no task's
   work.

Digits are compared by 128-bit hashes of the bytes.  The bytes to remove return to
their documents as ranges, and each document is cut in its own row.

Defined results: null text has no bytes; texts shorter than ``length`` are kept;
rows that repeat id and text are documents of their own, so they repeat each
other; matches never cross documents; the kept bytes may split a character; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrel.llm.common import row_key, written

LENGTH = 400
GRAM = 24
LOCAL = 256              # different runs of a group that one task sorts
BLOCKS = (16, 1)         # windows in a digit of the distributed passes
SEGMENT = 1 << 19        # bytes of a text worked off at a time
_PLACE = 20              # bits of a place within a segment

_U = np.uint64


def _mix(x: np.ndarray, k: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(k)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes at every place as a number."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,)).copy()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    grid = np.concatenate([x, np.full(-len(x) % width, _U((1 << 64) - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int, bytes]]:
    """``(gram, first, last, left, cid)`` of every run: first and last window, how far
    the anchor lies behind the first window, and a hash of bytes and ``left``."""
    out = []
    for start in range(0, len(data) - length + 1, SEGMENT):
        part = data[start:start + SEGMENT + length - 1]
        u = _eights(part)
        n = len(part) - GRAM + 1
        g = _mix(u[:n])
        for k in range(8, GRAM, 8):
            g = _mix(g ^ u[k:k + n])
        low = _sliding_min(g >> _U(_PLACE) << _U(_PLACE) | np.arange(n, dtype=np.uint64), length - GRAM + 1)
        anchor = (low & _U((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:] - 1, len(anchor) - 1]
        at = anchor[first]
        for f, t, a, gram in zip(first.tolist(), last.tolist(), at.tolist(), g[at].view(np.int64).tolist(), strict=True):
            cid = xxhash.xxh3_128_digest(part[f:t + length], seed=a - f)
            out.append((gram, start + f, start + t, a - f, cid))
    return out


def window_hashes(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window at every place, by doubling."""
    lanes = []
    for k in (0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93):
        h, size = _mix(_eights(data), k), 8
        while 2 * size <= length:
            h, size = _mix(_mix(h[:-size], k) + h[size:], k), 2 * size
        if size < length:
            h = _mix(_mix(h[:len(h) - length + size], k) + h[length - size:], k)
        lanes.append(h)
    return lanes[0], lanes[1]


def _find_runs(length: int):
    schema = pa.schema([("rid", pa.binary()), ("gram", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                        ("left", pa.int32()), ("cid", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rows = [], []
            for r, t in zip(batch.column("rid").to_pylist(), batch.column("data"), strict=True):
                found = runs(t.as_py(), length)
                rid += [r] * len(found)
                rows += found
                if len(rows) > 200_000:
                    yield _columns(schema, rid, rows)
                    rid, rows = [], []
            if rows:
                yield _columns(schema, rid, rows)

    return run


def _columns(schema: pa.Schema, rid: list, rows: list[tuple]) -> pa.RecordBatch:
    gram, first, last, left, cid = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((rid, gram, first, last, left, cid), schema, strict=True)],
                                      schema=schema)


_BYTES = pa.schema([("gram", pa.int64()), ("cid", pa.binary()), ("left", pa.int32()), ("m", pa.int64()), ("data", pa.binary())])


def _fetch(length: int):
    """A document and the runs wanted of it -> the bytes of each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"gram": w["gram"], "cid": w["cid"], "left": w["left"], "m": w["m"],
                    "data": t[w["first"]:w["first"] + w["wide"] + length]}
                   for t, wanted in zip((x.as_py() for x in batch.column("data")), batch.column("wanted").to_pylist(), strict=True)
                   for w in wanted]
            if out:
                yield pa.RecordBatch.from_pylist(out, _BYTES)

    return run


_RANGES = "cid binary, a int, b int"
_RANGE_TYPE = pa.schema([("cid", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])


def _sort_group(length: int):
    """All windows of one small group: those with an equal elsewhere, as ranges of
    window numbers of their run."""
    def run(group: pa.Table) -> pa.Table:
        data = dict(zip(group["cid"].to_pylist(), group["data"].to_pylist(), strict=True))   # equal runs once
        lanes = [window_hashes(d, length) for d in data.values()]
        h, h2 = (np.concatenate([x[k] for x in lanes]) for k in (0, 1))
        order = np.lexsort((h2, h))
        same = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out, at = [], 0
        for cid, (x, _) in zip(data, lanes, strict=True):
            edges = np.flatnonzero(np.diff(np.r_[0, twice[at:at + len(x)].astype(np.int8), 0]))
            out += [{"cid": cid, "a": a, "b": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
            at += len(x)
        return pa.Table.from_pylist(out, _RANGE_TYPE)

    return run


_DIGIT = "gram long, slot int, core binary, whole binary, cid binary, o1 int, o2 int"
_DIGIT_TYPE = pa.schema([("gram", pa.int64()), ("slot", pa.int32()), ("core", pa.binary()), ("whole", pa.binary()),
                         ("cid", pa.binary()), ("o1", pa.int32()), ("o2", pa.int32())])


def _digits(length: int, size: int):
    """Runs with the anchor offsets ``o1..o2`` still open -> their blocks of ``size`` windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                d, left = r["data"], r["left"]
                for slot in range(r["o1"] // size, r["o2"] // size + 1):
                    o1, o2 = max(r["o1"], slot * size), min(r["o2"], slot * size + size - 1)
                    core = d[left - slot * size:left - (slot * size + size - 1) + length]
                    whole = xxhash.xxh3_128_digest(d[left - o2:left - o1 + length], seed=o1 << 16 | o2)
                    out.append((r["gram"], slot, xxhash.xxh3_128_digest(core), whole, r["cid"], o1, o2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGIT_TYPE, strict=True)],
                                                 schema=_DIGIT_TYPE)

    return run


def _sort_large(data: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size, by distributed passes."""
    found = None
    open_runs = data.select("cid", (F.col("left") - (F.octet_length("data") - length)).alias("o1"), F.col("left").alias("o2"))
    for size in BLOCKS:
        digits = written(data.join(open_runs, "cid").select("gram", "cid", "left", "data", "o1", "o2")
                         .mapInArrow(_digits(length, size), _DIGIT), "digits")
        key = ["gram", "slot", "core"]
        spans = digits.groupBy(*key, "whole").agg(F.min("cid").alias("one"), F.max("cid").alias("other"),
                                                  F.first("o1").alias("o1"), F.first("o2").alias("o2"))
        twice = spans.where("one <> other").select(*key, "whole")
        ranges = digits.join(twice, [*key, "whole"]).select("cid", "o1", "o2")
        found = ranges if found is None else found.unionByName(ranges)
        split = spans.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("one") == F.col("other")).alias("alone")).where("n > 1 and alone")
        open_runs = written(spans.join(split, key).select(F.col("one").alias("cid"), "o1", "o2"), "open")
    lefts = data.select("cid", "left").distinct()
    return found.join(lefts, "cid").select("cid", (F.col("left") - F.col("o2")).alias("a"), (F.col("left") - F.col("o1")).alias("b"))


def ranges(text: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rid, data`` -> ``rid, ranges``: byte ranges ``[a, b)`` to remove, unordered."""
    found = text.where(F.octet_length("data") >= length).mapInArrow(
        _find_runs(length), "rid binary, gram long, first int, last int, left int, cid binary")
    shared = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    rows = written(found.join(shared, "gram"), "runs")
    different = rows.groupBy("gram", "cid").agg(
        F.count("*").alias("n"), F.first("left").alias("left"), F.first(F.col("last") - F.col("first")).alias("wide"),
        F.min(F.struct("rid", "first")).alias("at"))
    different = written(different, "different-runs")
    groups = different.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("gram", "m")
    wanted = (different.join(groups, "gram")
              .groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct(
                  "gram", "cid", "left", "wide", "m", F.col("at.first").alias("first"))).alias("wanted")))  # of one document
    data = written(text.join(wanted, "rid").select("data", "wanted").mapInArrow(
        _fetch(length), "gram long, cid binary, left int, m long, data binary").dropDuplicates(["cid"]), "run-bytes")
    small = data.where(F.col("m") <= LOCAL).groupBy("gram").applyInArrow(_sort_group(length), _RANGES)
    large = _sort_large(data.where(F.col("m") > LOCAL), length)
    full = different.where("n > 1").select("cid", F.lit(0).alias("a"), F.col("wide").alias("b"))
    repeated = full.unionByName(small).unionByName(large).groupBy("cid").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    return (rows.join(repeated, "cid")
            .select("rid", F.transform("parts", lambda p: F.struct((F.col("first") + p["a"]).alias("a"),
                                                                   (F.col("first") + p["b"] + length).alias("b"))).alias("parts"))
            .groupBy("rid").agg(F.flatten(F.collect_list("parts")).alias("ranges")))   # at most the runs of one document


@F.arrow_udf(T.StructType([
    T.StructField("kept", T.BinaryType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))]))
def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for data, found in batches:
        kept, spans = [], []
        for d, parts in zip(data, found.to_pylist(), strict=True):
            d, merged, out, at = d.as_py() or b"", [], [], 0
            for a, b in sorted((p["a"], p["b"]) for p in parts or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                out.append(d[at:a])
                at = b
            kept.append(b"".join([*out, d[at:]]))
            spans.append([{"a": a, "b": b} for a, b in merged])
        yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, span)], ["kept", "spans"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``kept`` (binary) and ``spans``, the
    maximal byte ranges ``[a, b)`` removed."""
    text = docs.select(row_key(id_col, text_col), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    found = ranges(text.select("rid", "data"), length)
    out = text.join(found, "rid", "left")
    return out.select("id", F.octet_length("data").cast("long").alias("n_bytes"), _cut("data", "ranges").alias("cut")).select(
        "id", "n_bytes", "cut.kept", "cut.spans")
