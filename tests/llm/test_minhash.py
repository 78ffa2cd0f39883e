import random

import numpy as np

from webrel.llm import components, minhash

from .data import docs, odd, random_texts, words


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] and not sets[a] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    out = {}
    for k in range(len(rows)):
        out.setdefault(find(k), []).append(rows[k][0])
    order = lambda i: (i is None, i or 0)
    return sorted(str((i, min(g, key=order), len(g))) for g in out.values() for i in g)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)[0]
    return " ".join(w)


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    base = random_texts(5, 25, 40, 200)
    texts = list(base) + ["a b", "a b", "A  B", "one"]
    for t in base[:12]:
        texts += [edited(rng, t, rng.randrange(0, 4)) for _ in range(6)]
    chain = base[0]
    for _ in range(10):  # each near the one before, the ends far apart
        chain = edited(rng, chain, 1)
        texts.append(chain)
    df = odd(spark, texts)
    got = sorted(str((r["id"], r["class_id"], r["class_size"])) for r in minhash.classes(df).collect())
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    kept = minhash.representatives(df)
    assert kept.columns == df.columns
    assert kept.count() == len({g.split(", ")[1] for g in got})
    assert minhash.classes(df.limit(0)).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / sum(max(a / x[d], b / y[d]) for a, b in zip(x, y, strict=True)) for d in both)
    a, b = (minhash.signature(ids[v > 0], v[v > 0], 4096) for v in (x, y))
    assert abs((a == b).mean() - want) < 0.04
    assert (minhash.signature(ids, np.ones(300), 64) == minhash.signature(ids[::-1].copy(), np.ones(300), 64)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (4, 5), (6, 6), (8, 7), (7, 5), *[(20 + k, 21 + k) for k in range(40)]]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 4, 8: 4, **{20 + k: 20 for k in range(41)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_link_lost_in_one_bucket(spark):
    """Two families that only meet in shared buckets stay apart."""
    df = docs(spark, [" ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(50, 150))])
    assert [r["class_size"] for r in minhash.classes(df).collect()] == [1, 1]


def test_links_with_repeated_passages_are_candidates(spark):
    """80 shared shingles; 20 of one text only, 16 of them about 100 times each: similarity 0.8."""
    texts = []
    for k in range(40):
        shared = " ".join(f"s{k}x{i}" for i in range(84))
        texts += [shared, shared + " " + " ".join([f"r{k}x{i}" for i in range(16)] * 100)]
    a, b = shingles(texts[0]), shingles(texts[1])
    assert len(a & b) == 80 and len(a | b) == 100
    assert {r["class_size"] for r in minhash.classes(docs(spark, texts)).collect()} == {2}
