"""Packing documents into sequences (operator 11): cutting-stock column generation.

A document is its token ids and one end id.  Whole runs of ``length`` ids are
sequences of their own; what is left of each document (its tail, shorter than a
sequence) is packed.  The histogram of tail lengths (at most ``length - 1``
rows) is all that the driver sees.  Over it a linear program chooses patterns,
that is lists of tail lengths that fill a sequence of ``length`` or of a power of
two exactly, at least cost; columns come from a knapsack by dynamic programming
over the prices of the current basis.  Patterns are rounded down, then taken once
more while their tails last.  Tails are ranked within their length, and the
rank tells pattern, sequence and offset by arithmetic.

What no pattern takes is laid end to end in order of length and cut at every
``length`` ids, the rest of that line at powers of two, so that nothing is padded
at all; a cut is the price there, at most one for each such sequence.

Scale.  Tokenising writes one row per document (digests of its pieces and the ids
of its tail) to the shared folder; ranking moves only narrow rows, and a length
that a third of all documents share spans many tasks (``rank_within``).  The
plan has at most a row per pattern and length in it, bounded by the sequence
length whatever the data, so it is broadcast.  The linear program works on at
most ``length - 1`` rows: a few seconds at any number of documents.

Tokenising.  tiktoken with the vocabulary, merge order and word pattern of the
tokenizers file; it gives the same ids (tested) and is four times as fast.

Defined results: a null text is empty; an empty text is the end id alone; rows that
repeat are packed each for itself; a null id is an id like others; very long texts
are cut into whole sequences; an empty table gives no rows; extra columns are
ignored, whatever their names.  Reruns on the same rows give the same packing up to
the exchange of rows with equal id and ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrel.llm.bpe import PIECES, byte_letters
from webrel.llm.common import maybe_in, written
from webrel.operators.graph import rank_within

LENGTH = 2048
END_ID = 1
SLICE = 8 << 20      # bytes of text whose ids a worker holds at a time
PER_SEQUENCE = 64.0  # cost of a sequence beside its ids, in ids
PER_CUT = 256.0      # cost of a cut, in ids
ROUND = 128          # columns that one pricing may bring into the basis
ROUNDS = 60          # pricings at most; any basis packs all tails, a better one cuts less
NEAR = 0.001         # share of the cost that may be above the least
FOLD = 64            # changes of the basis kept beside its inverse
TINY = 1e-6


def read_tokenizer(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Spelling -> id of a byte-level file, and its special tokens.  Merging by id is
    merging by rank only where later merges have larger ids, which is checked."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, letters = file["model"]["vocab"], byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("ids do not follow the order of merges")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    return {bytes(letters[ch] for ch in t): i for t, i in vocab.items() if t not in special}, special


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
            length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per document: ``id``, ``pid, row`` (its task and place there), ``n``
    ids, ``runs`` (digests of its whole runs), ``runs_before`` (runs of earlier rows of
    its task), ``tail`` (ids left), their digest ``crc`` and the ids themselves."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, pid int, row long, n long, runs array<long>, "
              "runs_before long, tail int, crc long, ids binary")
    types = [("pid", pa.int32()), ("row", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(pa.int64())),
             ("runs_before", pa.int64()), ("tail", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, special = shared.value
        coder = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        end = np.array([end_id], "<u4")
        pid, row, runs_before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            first, out, held = 0, {name: [] for name, _ in types}, 0
            for k, text in enumerate(batch.column(1)):
                s = text.as_py() or ""
                ids = np.concatenate([coder.encode_to_numpy(s, allowed_special="all").astype("<u4"), end])
                whole = len(ids) // length
                runs = [zlib.crc32(ids[j * length:(j + 1) * length]) for j in range(whole)]
                rest = ids[whole * length:]
                values = (pid, row, len(ids), runs, runs_before, len(rest), zlib.crc32(rest), rest.tobytes())
                for (name, _), v in zip(types, values, strict=True):
                    out[name].append(v)
                row, runs_before, held = row + 1, runs_before + whole, held + len(s)
                if held >= SLICE or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, k + 1 - first), *[pa.array(out[name], t) for name, t in types]],
                        names=["id", *[name for name, _ in types]])
                    first, out, held = k + 1, {name: [] for name, _ in types}, 0

    return written(rows.mapInArrow(run, schema), "pack-ids")


# --- the plan: histogram of tail lengths -> patterns -------------------------

def price(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the highest sum of values of sizes that add up
    to exactly c, for every c, and the place of the size added last (-1: none)."""
    best = np.full(length + 1, -np.inf)
    last = np.full(length + 1, -1)
    best[0] = 0.0
    for c in range(1, length + 1):
        m = np.searchsorted(sizes, c, "right")
        if m:
            sums = best[c - sizes[:m]] + values[:m]
            last[c] = k = int(sums.argmax())
            best[c] = sums[k]
    last[np.isinf(best)] = -1
    return best, last


def fill(total: int, last: np.ndarray, sizes: np.ndarray) -> dict[int, int]:
    """The sizes (by place, with how often) of the best filling of ``total``."""
    found: dict[int, int] = {}
    while total:
        k = int(last[total])
        found[k] = found.get(k, 0) + 1
        total -= int(sizes[k])
    return found


def first_patterns(sizes: np.ndarray, counts: np.ndarray, length: int) -> list[dict[int, int]]:
    """Fillings to start from: the largest size that is left, completed to exactly a sequence
    by other sizes that are left (large ones first), as often as all of them last.
    Which sums the smaller sizes reach is a bit set held as a whole number."""
    left, values, out = counts.tolist(), sizes.tolist(), []
    full = (1 << (length + 1)) - 1
    for k in range(len(values) - 1, -1, -1):
        while left[k] > 0:
            room, sums = length - values[k], [(1, -1)]
            for j in range(k + 1):
                if values[j] > room:
                    break
                if left[j] > (j == k):
                    sums.append(((sums[-1][0] | sums[-1][0] << values[j]) & full, j))
            if not sums[-1][0] >> room & 1:
                break
            pattern = {k: 1}
            while room:
                reached, j = sums.pop()
                if room >= values[j] and sums[-1][0] >> (room - values[j]) & 1:
                    pattern[j] = pattern.get(j, 0) + 1
                    room -= values[j]
            n = min(left[j] // t for j, t in pattern.items())
            for j, t in pattern.items():
                left[j] -= n * t
            out.append(pattern)
    return out


def patterns(sizes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[tuple[dict[int, int], float]]:
    """The linear program by column generation: patterns (place of a size -> how often)
    with the times each is used.  The first basis lays every size end to end; the
    inverse of the basis is kept as a matrix and the latest ``FOLD`` changes beside it.
    It ends when no basis can cost less by more than ``NEAR`` of the whole: with every
    filling worth at most 1 + e of its cost, prices divided by 1 + e bound the cost below;
    so does the cost of full sequences alone."""
    m = len(sizes)
    inverse, left, right, n = np.eye(m), np.zeros((m, FOLD)), np.zeros((FOLD, m)), 0
    x = counts + np.random.default_rng(0).uniform(0, 0.01, m)   # no ties between rows that leave
    duals = sizes * (length + PER_SEQUENCE + PER_CUT) / length
    basis: list[dict[int, int] | None] = [None] * m

    def enter(pattern: dict[int, int], own: float) -> bool:
        """Brings a pattern into the basis if it lowers the cost at the prices of now."""
        nonlocal inverse, duals, n
        at, times = np.fromiter(pattern, int), np.fromiter(pattern.values(), float)
        gain = duals[at] @ times - own
        if gain <= TINY:
            return False
        step = inverse[:, at] @ times + np.einsum("ij,j", left[:, :n], right[:n, at] @ times)
        able = np.flatnonzero(step > 1e-9)
        if not len(able):
            return False
        ratio = x[able] / step[able]
        out = int(able[ratio.argmin()])
        line = inverse[out] + np.einsum("i,ij", left[out, :n], right[:n])
        duals -= gain / step[out] * line
        theta = x[out] / step[out]
        np.maximum(x - theta * step, 0.0, out=x)
        x[out], basis[out] = theta, pattern
        left[:, n] = -step / step[out]
        left[out, n] += 1 / step[out]
        right[n] = line
        n += 1
        if n == FOLD:
            inverse += left @ right
            n = 0
        return True

    for pattern in first_patterns(sizes, counts, length):
        enter(pattern, length + PER_SEQUENCE)
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    least = sizes @ counts * (length + PER_SEQUENCE) / length
    for _ in range(ROUNDS):
        best, last = price(duals, sizes, length)
        wanted = [(best[c] - c - PER_SEQUENCE, c, None) for c in powers if last[c] >= 0]   # (gain, closing length, size it must hold)
        rest = best[length - sizes] + duals - length - PER_SEQUENCE
        wanted += [(rest[k], length, int(k)) for k in np.flatnonzero(rest > TINY)]
        worst = max([g / (c + PER_SEQUENCE) for g, c, _ in wanted], default=0.0)
        if worst <= NEAR or duals @ counts <= least * (1 + NEAR):
            break
        for _, total, k in sorted((w for w in wanted if w[0] > TINY), key=lambda w: -w[0])[:ROUND]:
            pattern = fill(total if k is None else total - int(sizes[k]), last, sizes)
            if k is not None:
                pattern[k] = pattern.get(k, 0) + 1
            enter(pattern, total + PER_SEQUENCE)
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if p is not None and v > 1e-9]


def rounded(found: list[tuple[dict[int, int], float]], sizes: np.ndarray, counts: np.ndarray,
            length: int = LENGTH) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole numbers of sequences per pattern, and the tails that no pattern takes: rounded
    down, then once more by falling remainder while tails last, then ``first_patterns`` of the rest."""
    left, uses = counts.copy(), []

    def take(pattern: dict[int, int], most: int) -> None:
        n = min(most, *[int(left[k]) // t for k, t in pattern.items()])
        if n:
            for k, t in pattern.items():
                left[k] -= n * t
            uses.append((pattern, n))

    for pattern, v in found:
        take(pattern, int(v + TINY))
    for pattern, v in sorted(found, key=lambda f: int(f[1] + TINY) - f[1]):
        if v - int(v + TINY) > TINY:
            take(pattern, 1)
    for pattern in first_patterns(sizes, left, length):
        take(pattern, int(left.sum()))
    return uses, left


def plan(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple], list[tuple], int, int]:
    """``slots``: (tail, first rank, rank after the last, tails in a sequence, first
    sequence, offset); ``line``: (tail, first rank, place of that tail in the line of what is
    left); the number of sequences by patterns; the ids in the line."""
    sizes = np.array(sorted(histogram), int)
    counts = np.array([histogram[s] for s in sizes.tolist()], int)
    uses, left = rounded(patterns(sizes, counts, length), sizes, counts, length) if len(sizes) else ([], counts)
    ranks, slots, sequence = np.ones(len(sizes), int), [], 0
    for pattern, n in uses:
        offset = 0
        for k, times in sorted(pattern.items(), reverse=True):
            a = int(ranks[k])
            ranks[k] += times * n
            slots.append((int(sizes[k]), a, int(ranks[k]), times, sequence, offset))
            offset += times * int(sizes[k])
        sequence += n
    line, place = [], 0
    for k in range(len(sizes)):
        if left[k]:
            line.append((int(sizes[k]), int(ranks[k]), place))
            place += int(left[k]) * int(sizes[k])
    return slots, line, sequence, place


def cuts(place: int, tail: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start in the tail, length, sequence of the line, offset) of a tail that lies
    at ``place`` in a line of ``total`` ids: cut at every ``length`` and, beyond the last
    whole one, at powers of two from the largest down."""
    out, at = [], place
    whole = total // length * length
    while at < place + tail:
        if at < whole:
            sequence, begin, size = at // length, at // length * length, length
        else:
            sequence, begin, rest = whole // length, whole, total - whole
            while True:
                size = 1 << (rest.bit_length() - 1)
                if at < begin + size:
                    break
                sequence, begin, rest = sequence + 1, begin + size, rest - size
        end = min(place + tail, begin + size)
        out.append((at - place, end - at, sequence, at - begin))
        at = end
    return out


# --- on Spark ----------------------------------------------------------------

def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``crc`` (of the piece's ids,
    little-endian unsigned 32 bits), ``tokens`` of the document, ``sequence``, ``offset``."""
    spark = docs.sparkSession
    ids = encoded(docs, path, id_col, text_col, length, end_id)
    tails = ids.where("tail > 0")
    histogram = {r["tail"]: r["count"] for r in tails.groupBy("tail").count().collect()}  # < length rows
    slots, line, packed, total = plan(histogram, length)
    in_line = total // length + bin(total % length).count("1")

    ranked = rank_within(tails.select("id", "pid", "row", "n", "tail", "crc"), "tail", ["id", "crc", "pid", "row"])
    slot = spark.createDataFrame(slots, "p_tail int, lo long, hi long, times long, sequence long, offset long")
    mine = F.col("rn") - F.col("lo")
    whole = (ranked.join(F.broadcast(slot), (F.col("tail") == F.col("p_tail")) & (F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi")))
             .select("id", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"), "crc",
                     F.col("n").alias("tokens"), (F.col("sequence") + F.expr("(rn - lo) div times")).alias("sequence"),
                     (F.col("offset") + mine % F.col("times") * F.col("tail")).alias("offset")))

    rest = spark.createDataFrame(line, "p_tail int, lo long, place long")
    rest = (ranked.join(F.broadcast(rest), (F.col("tail") == F.col("p_tail")) & (F.col("rn") >= F.col("lo")))
            .select("pid", "row", (F.col("place") + mine * F.col("tail")).alias("place")))
    rest = written(rest, "pack-line")
    key = F.struct("pid", "row")
    cut = maybe_in(tails.select("id", "pid", "row", "n", "tail", "ids"), key, rest, key).join(rest, ["pid", "row"])
    kind = cut.schema["id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            at, out = [], []
            for k, (n, tail, raw, place) in enumerate(zip(rows["n"], rows["tail"], rows["ids"], rows["place"], strict=True)):
                for a, size, sequence, offset in cuts(place, tail, total, length):
                    at.append(k)
                    out.append((n - tail + a, size, zlib.crc32(raw[4 * a:4 * (a + size)]), n, packed + sequence, offset))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns],
                                             names=["id", "start", "length", "crc", "tokens", "sequence", "offset"])

    parts = cut.select("id", "n", "tail", "ids", "place").mapInArrow(
        pieces, f"id {kind}, start long, length long, crc long, tokens long, sequence long, offset long")

    tasks = ids.groupBy("pid").agg(F.sum(F.size("runs")).alias("runs"))   # one row per task of the scan
    before = F.coalesce(F.sum("runs").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("pid", before.alias("before"))
    runs = (ids.where(F.size("runs") > 0).select("id", "pid", "n", "runs_before", "runs").join(tasks, "pid")
            .select("id", "n", (F.col("before") + F.col("runs_before") + packed + in_line).alias("base"), F.posexplode("runs").alias("j", "crc"))
            .select("id", (F.col("j") * F.lit(length)).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "crc",
                    F.col("n").alias("tokens"), (F.col("base") + F.col("j")).alias("sequence"), F.lit(0).cast("long").alias("offset")))
    return whole.unionByName(parts).unionByName(runs)
