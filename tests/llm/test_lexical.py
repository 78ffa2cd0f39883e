import math
import random
import re
from collections import Counter

import numpy as np
from tests.llm.data import DOC, odd, words

from webrel.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            if not b:
                continue
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t in TERM.findall((text or "").translate(LOWER)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    pool = words(rng, 400)
    weights = [1 / (r + 1) for r in range(400)]
    return [" ".join(rng.choices(pool, weights, k=rng.randrange(1, 80))) for _ in range(n)], pool, rng


def run(spark, docs, items, k=20):
    got = lexical.search(docs, items, k).collect()
    return sorted([(r["item"], r["rank"], r["id"], r["score"]) for r in got], key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 500)     # many shards a task
    body, pool, rng = texts(2, 400)
    body += ["É" + body[0].upper(), "wide 日本語 text日 " + body[1], body[2], ("long " + body[3] + " ") * 900]
    docs = odd(spark, body)
    asked = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 30)))) for i in range(30)]
    asked += [(90, None), (91, ""), (92, "unseen 日本語 É"), (93, asked[0][1]), (93, asked[0][1]), (None, pool[5] + " " + pool[5])]
    items = spark.createDataFrame([(i, t, "x", 1.0, "k") for i, t in asked], "item_id long, text string, id string, score double, key string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert run(spark, docs, items) == brute(rows, asked, 20)
    assert run(spark, docs, items, 1) == brute(rows, asked, 1)
    monkeypatch.setattr(lexical, "BLOCK", 600)     # several blocks of queries
    assert run(spark, docs, items, 3) == brute(rows, asked, 3)


def test_empty_tables(spark):
    docs = odd(spark, ["some words"])
    items = spark.createDataFrame([(1, "some")], "item_id long, text string")
    assert run(spark, spark.createDataFrame([], DOC), items) == []
    assert run(spark, docs, items.where("false")) == []


def test_accumulators_stop():
    """Documents without a rare term get no accumulator once the common ones cannot lift them."""
    n = 1000
    at = np.concatenate([[0, 1] if i < 30 else [1] for i in range(n)])
    ends = np.cumsum([0, *[2 if i < 30 else 1 for i in range(n)]])
    shard = lexical.Shard(np.arange(n), np.full(n, 10), ends, at, np.ones(n + 30, int), n, 10 * n)
    looked_up = []

    class Share(np.ndarray):
        def __getitem__(self, k):
            looked_up.append(np.ndarray.__getitem__(self, k).size)
            return np.asarray(np.ndarray.__getitem__(self, k))

    shard.share = shard.share.view(Share)
    ids, scores = shard.search([(0, 9000), (1, 5)], 20, 0)
    assert ids.tolist() == list(range(20)) and len(set(scores.tolist())) == 1
    partial = 9000 * int(np.asarray(shard.share)[0])
    assert scores[0] > partial                       # survivors went on
    assert shard.search([(0, 9000), (1, 5)], 20, int(scores[0]) + 1)[0].size == 0
    assert looked_up[0] == 30
