"""Toxicity (operator 5): class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary text, run
over the letters of each word (``ORDER`` letters, with a start and an end mark).
Both fall back to the same lower order, whose continuation counts are taken
over *all* documents, so a rare expression that neither class has seen is judged
by what both share and contributes nothing, while unseen inflections of a known
insult still carry its stem.

    P_c(x | h) = (max(n_c(h x) - D, 0) + D * N_c(h .) * P(x | h')) / n_c(h)
    P(x | h')  = N(. h' x) / N(. h' .)          shared continuation counts

A word's value is its log-likelihood under the toxic model less that under the
ordinary one.  A document is compared by length-normalised values: the mean over
its words, the mean of what exceeds ``STRONG`` nats, the highest word, and the
logarithm of its length.  A logistic curve fitted on held-back training rows turns
them into a score from 0 to 1.

Scale.  One pass counts letter groups of all documents (each task counts its
words first, then the groups are summed by a shuffle with partial sums); it
grows with the corpus.  Class counts use at most ``sample`` labelled rows, chosen
by the hash of their id; that bounded table is the only broadcast on the way.
The model keeps every letter group of that sample, so nothing but the sample bounds
it, and goes to the tasks as one sorted array (12 bytes a group or history); the
driver and each Python worker must hold it.
Scoring is an Arrow column function without a shuffle; a task remembers the
values of its words.

Defined results: null and empty texts have no words and get the score of a
document whose features are all zero; labels other than 0 and 1, and null ids
among the labels, are not learned from; a document labelled more than once is
toxic if any of its labels is; repeated rows score alike.  With labels of only
one class (or none) every score is the share of toxic labels (0 without labels).
Labels, language, source and id are no inputs of a score.  An empty table gives no rows;
long texts are scored whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.llm.common import written

ORDER = 5
DISCOUNT = 0.75
STRONG = 4.0
SAMPLE = 60_000        # labelled rows learned from, at most
FLUSH = 80_000         # distinct words that a counting task holds at most,
FLUSH_BYTES = 8 << 20  # letters of the texts they are new in at most,
SLICE = 1 << 17        # letters whose groups it makes at a time,
GROUPS = 400_000       # and groups it holds before it hands them on


class Model(NamedTuple):
    keys: np.ndarray     # uint64, sorted: letter groups, and histories for unseen groups
    values: np.ndarray   # float32: log-likelihood ratio
    weights: np.ndarray  # of the logistic curve; the first is the constant
    constant: float | None  # score of everything, where only one class was seen


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def letter_groups(words: list[str]):
    """Hashes of every position of every word: group ``h x``, history ``h``,
    shared group ``h' x``, shared history ``h'``; and the word of each."""
    marked = "\1" * (ORDER - 1) + ("\2" + "\1" * (ORDER - 1)).join(words) + "\2"
    ch = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(word)) + word * (ORDER - 1)   # first letter of each group
    seed = np.uint64(ORDER)
    sub_h = np.full(len(place), seed)
    for k in range(1, ORDER - 1):
        sub_h = _mix(sub_h + ch[place + k])
    first, last = ch[place], ch[place + ORDER - 1]
    hist = _mix(sub_h ^ _mix(first + np.uint64(1 << 32)))
    return _mix(hist + _mix(last + np.uint64(2 << 32))), hist, _mix(sub_h + _mix(last + np.uint64(3 << 32))), sub_h, word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> letter groups with the counts of both classes."""
    names = ["gram", "hist", "sub", "sub_hist", "toxic", "plain"]
    seen: set[str] = set()
    labelled = Counter(), Counter()   # plain, toxic: words of at most ``SAMPLE`` texts
    size = 0
    held: list[np.ndarray] = []       # groups of the words that are forgotten

    def groups(words: list[str]) -> list[np.ndarray]:
        """The different letter groups of some words with their counts."""
        *keys, word = letter_groups(words)
        n = np.array([[labelled[1][w], labelled[0][w]] for w in words], np.int64)[word]
        return _summed([*keys, n[:, 0], n[:, 1]])

    def forget() -> None:
        nonlocal held
        parts, words, letters = [held] if held else [], [], 0
        for w in seen:
            words.append(w)
            letters += len(w) + 1
            if letters >= SLICE:
                parts.append(groups(words))
                words, letters = [], 0
        if words:
            parts.append(groups(words))
        held = _summed([np.concatenate(c) for c in zip(*parts, strict=True)]) if len(parts) > 1 else parts[0]
        seen.clear()
        labelled[0].clear()
        labelled[1].clear()

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            text = (text.as_py() or "").lower()
            before = len(seen)
            seen.update(text.split())
            if toxic.is_valid:
                labelled[toxic.as_py()].update(text.split())
            if len(seen) > before:
                size += len(text)
            if len(seen) > FLUSH or size > FLUSH_BYTES:
                forget()
                size = 0
                if len(held[0]) > GROUPS:
                    yield batch_of(held)
                    held = []
    if seen:
        forget()
    if held:
        yield batch_of(held)


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of (group, its other keys, toxic, plain) with one row per group."""
    gram, at, back = np.unique(columns[0], return_index=True, return_inverse=True)
    sums = [np.bincount(back, c, len(gram)).astype(np.int64) for c in columns[4:]]
    return [gram, *[c[at] for c in columns[1:4]], *sums]


def _features(text: str, value: dict[str, float], model: Model) -> tuple[float, float, float, float]:
    words = text.lower().split()
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    new = [w for w in set(words) if w not in value]
    own = {w: value[w] for w in set(words) if w in value}
    if new:
        gram, hist, _, _, word = letter_groups(new)
        out = np.zeros(len(gram), np.float32)
        todo = np.ones(len(gram), bool)
        for keys in (gram, hist):
            at = np.minimum(np.searchsorted(model.keys, keys), max(len(model.keys) - 1, 0))
            hit = todo & (model.keys[at] == keys) if len(model.keys) else np.zeros(len(gram), bool)
            out[hit] = model.values[at[hit]]
            todo &= ~hit
        got = dict(zip(new, np.bincount(word, out, len(new)).tolist(), strict=True))
        own.update(got)
        if len(value) > FLUSH:
            value.clear()
        value.update(got)
    x = np.fromiter(map(own.__getitem__, words), np.float64, len(words))
    return float(x.mean()), float(np.maximum(x - STRONG, 0).mean()), float(x.max()), float(np.log1p(len(x)))


def _counts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = text.join(F.broadcast(sample.where("fit")), "id", "left").select("text", F.col("toxic").cast("int").alias("toxic"))
    grams = rows.mapInArrow(_count, "gram long, hist long, sub long, sub_hist long, toxic long, plain long")
    return grams.groupBy("gram").agg(*[F.first(c).alias(c) for c in ("hist", "sub", "sub_hist")],
                                     F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _ratios(grams: DataFrame) -> DataFrame:
    """``(key, value)`` of the model: every letter group and history of the sample."""
    shared = grams.groupBy("sub_hist", "sub").agg(F.count("*").alias("n_sub"))
    shared_h = shared.groupBy("sub_hist").agg(F.sum("n_sub").alias("n_sub_hist"))
    seen = grams.where("toxic + plain > 0")
    hist = seen.groupBy("hist").agg(*[f(c).alias(f"{a}_{c}") for c in ("toxic", "plain") for f, a in
                                      ((F.sum, "n"), (lambda c: F.count(F.when(F.col(c) > 0, 1)), "kinds"))])
    d = F.lit(DISCOUNT)
    back = {c: F.when(F.col(f"n_{c}") > 0, d * F.col(f"kinds_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0)) for c in ("toxic", "plain")}
    x = (seen.join(hist, "hist").join(shared, ["sub_hist", "sub"]).join(shared_h, "sub_hist")
         .withColumn("low", F.col("n_sub") / F.col("n_sub_hist")))
    p = {c: F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0))
         + back[c] * F.col("low") for c in ("toxic", "plain")}
    of_grams = x.select(F.col("gram").alias("key"), F.log(p["toxic"] / p["plain"]).alias("value"))
    of_hist = hist.select(F.col("hist").alias("key"), F.log(back["toxic"] / back["plain"]).alias("value"))
    return of_grams.unionByName(of_hist).select("key", F.col("value").cast("float"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) by Newton steps with a small ridge."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / sd]
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ b)
    w = b[1:] / sd
    return np.r_[b[0] - w @ mean, w]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """The model from the labelled rows given (at most ``sample`` of them) and all texts."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()   # at most ``sample`` rows
    y = chosen["toxic"].to_numpy(int)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(5)
    if len(set(y.tolist())) < 2:
        return Model(*empty, float(y.mean()) if len(y) else 0.0)
    spark = docs.sparkSession
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # a fifth of each class is held back for the curve
        held[np.flatnonzero(y == c)[4::5]] = True
    chosen["fit"] = ~held
    sample_df = spark.createDataFrame(chosen[["id", "toxic", "fit"]])
    got = _ratios(written(_counts(docs, sample_df, id_col, text_col), "letters")).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], got["value"].to_numpy()[order], np.zeros(5), None)
    curve = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(sample_df.where("not fit")), "id")
             .select("toxic", _columns(spark, model)("text").alias("x"))).toArrow()   # at most a fifth of the sample
    if curve.num_rows == 0 or len(set(curve["toxic"].to_pylist())) < 2:
        return model._replace(weights=np.array([-2.0, 1.0, 1.0, 0.0, 0.0]))
    x = np.array(curve["x"].to_pylist())
    return model._replace(weights=_logistic(x, np.array(curve["toxic"].to_pylist(), float)))


def _columns(spark, model: Model):
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        value: dict[str, float] = {}
        held = Model(*shared.value)
        for batch in batches:
            yield pa.array([list(_features(t.as_py() or "", value, held)) for t in batch], pa.list_(pa.float64()))

    return features


def score(spark, model: Model, text: Column | str) -> Column:
    """Score of a text column, 0 to 1."""
    if model.constant is not None:
        return F.lit(model.constant)
    x = _columns(spark, model)(text)
    w = [float(v) for v in model.weights]
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in w[1:]]), lambda a, b: a * b), F.lit(w[0]),
                       lambda s, v: s + v, lambda s: 1 / (1 + F.exp(-s)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
