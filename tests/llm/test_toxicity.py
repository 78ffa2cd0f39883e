import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webrel.llm import toxicity

from .data import docs, odd, words


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(600):
        w = words(rng, rng.randrange(20, 120))
        toxic = k % 6 == 0
        for _ in range(max(1, len(w) // 30) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["grolth", "GROLTHISH", "xuzquu,"])
        texts.append(" ".join(w))
        labels.append((k, int(toxic)))
    return odd(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_held_out_accuracy(spark, corpus):
    df, labels, truth = corpus
    held = toxicity.held_out()
    model = toxicity.fit(df, labels.where(~held))
    rows = df.select("doc_id", "text", held.alias("held"), toxicity.score(spark, model, "text").alias("p")).collect()
    assert len(rows) == df.count()
    assert all(0 <= r["p"] <= 1 for r in rows)
    tested = [((r["p"] >= 0.3) == bool(truth[r["doc_id"]])) for r in rows if r["held"] and r["doc_id"] in truth]
    assert len(tested) > 100 and np.mean(tested) > 0.97
    blank = {r["p"] for r in rows if not (r["text"] or "").split()}
    assert len(blank) == 1
    same = [r["p"] for r in rows if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]


def test_labels_of_one_class_or_none(spark, corpus):
    df, labels, _ = corpus
    for few, want in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        model = toxicity.fit(df, few)
        assert {r[0] for r in df.select(toxicity.score(spark, model, "text")).collect()} == {want}
    assert docs(spark, ["a"]).limit(0).select(toxicity.score(spark, model, "text")).collect() == []


def test_letter_groups_share_suffixes():
    gram, hist, sub, sub_h, word = toxicity.letter_groups(["abc", "zabc"])
    assert len(gram) == 4 + 5 and list(word) == [0] * 4 + [1] * 5
    assert sub[3] == sub[8] and sub_h[3] == sub_h[8]       # the end after "abc"
    assert gram[3] != gram[8] and hist[3] != hist[8]       # after "\1abc" and "zabc"
    again = toxicity.letter_groups(["zabc"])
    assert (again[0] == gram[4:]).all() and (again[1] == hist[4:]).all()


def test_forgetting_words_changes_nothing(monkeypatch):
    model = toxicity.Model(np.sort(toxicity.letter_groups(["bad"])[0]), np.arange(4, dtype=np.float32) + 3, np.zeros(5), None)
    want = toxicity._features("a bad day bad", {}, model)
    monkeypatch.setattr(toxicity, "FLUSH", 1)
    cache = {}
    assert [toxicity._features(t, cache, model) for t in ("x y z", "a bad day bad", "q", "a bad day bad")][1::2] == [want, want]


def test_text_of_cached_and_many_new_words(monkeypatch):
    model = toxicity.Model(np.sort(toxicity.letter_groups(["bad"])[0]), np.arange(4, dtype=np.float32) + 3, np.zeros(5), None)
    want = toxicity._features("x a bad", {}, model)
    monkeypatch.setattr(toxicity, "FLUSH", 1)
    cache = {}
    toxicity._features("x y", cache, model)
    assert toxicity._features("x a bad", cache, model) == want


def test_model_keeps_every_group_of_the_sample(spark):
    """200,000 words that occur once each, four fifths of them in the fitted rows."""
    texts = [" ".join(f"{(k * 2000 + i) * 2654435761 % 2**32:08x}" for i in range(2000)) for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark, texts), labels)
    assert len(model.keys) > 500_000
    assert (np.diff(model.keys.astype(object)) > 0).all()


def brute_ratio(texts, labels):
    """Value of a word by the formulas, on plain dicts of letters."""
    k = toxicity.ORDER

    def groups(word):
        marked = "\1" * (k - 1) + word + "\2"
        return [marked[i:i + k] for i in range(len(word) + 1)]

    every = {g for t in texts for w in (t or "").lower().split() for g in groups(w)}
    n = [Counter(), Counter()]
    for t, label in zip(texts, labels, strict=True):
        if label is not None:
            n[label].update(g for w in (t or "").lower().split() for g in groups(w))
    d = toxicity.DISCOUNT

    def back(c, h):
        total = sum(v for g, v in n[c].items() if g[:-1] == h)
        return (d * sum(1 for g in n[c] if g[:-1] == h) / total, total) if total else (1.0, 0)

    def value(g):
        h = g[:-1]
        if not any(back(c, h)[1] for c in (0, 1)):
            return 0.0
        if not (n[0][g] or n[1][g]):
            return math.log(back(1, h)[0] / back(0, h)[0])
        low = sum(1 for x in every if x[1:] == g[1:]) / sum(1 for x in every if x[1:-1] == g[1:-1])
        p = [(max(n[c][g] - d, 0) / back(c, h)[1] if back(c, h)[1] else 0.0) + back(c, h)[0] * low for c in (0, 1)]
        return math.log(p[1] / p[0])

    return lambda word: sum(value(g) for g in groups(word.lower()))


@pytest.mark.parametrize("slice_", [1 << 19, 7])
def test_values_by_the_formulas(spark, monkeypatch, slice_):
    monkeypatch.setattr(toxicity, "SLICE", slice_)
    texts = ["you bad badger", "bad Bad day", "mad bat", "a sad cad", "good day", "a goodly day at bay", "the day", "may I",
             "unlabelled badly goods 日本", "", None, "bad badger gad"]
    labels = [1, 1, 1, 1, 0, 0, 0, 0] + [None] * 4
    known = spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v is not None], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark, texts), known)
    want = brute_ratio(texts, labels)
    for word in ("bad", "Badger", "day", "goodly", "unseen", "日本", "badly", "a", "gad", "mayday"):
        assert toxicity._features(word, {}, model)[0] == pytest.approx(want(word), abs=1e-4)


def test_counting_holds_few_words(monkeypatch):
    """Words are forgotten while their groups are held: fewer rows leave the task, and the counts are the same."""
    texts = [" ".join(f"w{(k * 37 + i) % 400}" for i in range(50)) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 3 if k % 3 < 2 else None for k in range(60)], pa.int32())], ["text", "toxic"])

    def counted():
        rows = [r for b in toxicity._count(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        sums = Counter()
        for *keys, toxic, plain in rows:
            sums.update({(*keys, 1): toxic, (*keys, 0): plain})
        return len(rows), sums

    n, want = counted()
    monkeypatch.setattr(toxicity, "FLUSH", 20)
    assert counted() == (n, want)
    monkeypatch.setattr(toxicity, "GROUPS", 50)
    again, got = counted()
    assert again > n and got == want
