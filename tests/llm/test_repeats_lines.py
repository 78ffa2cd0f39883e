import random

import pytest
from pyspark.sql import functions as F

from webrel.llm import lines, repeats

from .data import docs, odd, random_texts, words


def brute_repeats(data, w):
    seen = {}
    for b in data:
        for k in range(len(b) - w + 1):
            seen[b[k:k + w]] = seen.get(b[k:k + w], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if seen[b[k:k + w]] > 1:
                gone[k:k + w] = b"\1" * w
        spans = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("local", [256, 1])
def test_repeats_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(repeats, "LOCAL", local)
    rng = random.Random(7)
    shared = [" ".join(words(rng, 120)) for _ in range(4)]
    texts = []
    for _ in range(24):
        parts = [" ".join(words(rng, rng.randrange(5, 90))) for _ in range(2)]
        p = rng.choice(shared)
        cut = rng.randrange(0, len(p) // 3)
        texts.append(parts[0] + p[cut:] + parts[1])
    texts += [texts[0], "ab" * 400, "é" * 260, shared[0][:410], shared[0][:399], "x" * 5000]
    df = odd(spark, texts)
    got = [(r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
           for r in repeats.dedup(df).collect()]
    want = brute_repeats([(r["text"] or "").encode() for r in df.collect()], repeats.LENGTH)
    assert sorted(got) == sorted(want)
    assert repeats.dedup(df.limit(0)).count() == 0


def test_segments_do_not_change_the_result(monkeypatch):
    rng = random.Random(1)
    data = " ".join(words(rng, 900)).encode()
    whole = repeats.runs(data)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = repeats.runs(data)
    cover = lambda rs: sorted(w for _, f, t, _, _ in rs for w in range(f, t + 1))
    assert cover(whole) == cover(parts) == list(range(len(data) - repeats.LENGTH + 1))


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [words(rng, rng.randrange(6, 14)) for _ in range(12)]
    texts = []
    for _ in range(40):
        made = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, at = rng.randrange(3), rng.randrange(len(w))
                w[at:at + (k != 0)] = words(rng, 1) if k < 2 else []
            made.append(rng.choice(["", "", "", " "]) + " ".join(w))
        texts.append("\n".join(made + [""] * rng.randrange(2)))
    df = odd(spark, texts + ["one\ntwo\none", "\n\n"])
    first = {}
    for r in df.collect():
        for no, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(" "):
                at = (r["doc_id"] is None, r["doc_id"] or 0, no)
                first[line] = min(first.get(line, at), at)
    drop = {x for x, at in first.items() if any(
        first[y] < at and min(len(x.split(" ")), len(y.split(" "))) >= lines.MIN_WORDS and within_one(x.split(" "), y.split(" ")) for y in first if y != x)}
    want = []
    for r in df.collect():
        if r["text"] is None:
            want.append((r["doc_id"], None))
            continue
        kept = [x for no, x in enumerate(r["text"].split("\n"))
                if not x.strip(" ") or (x not in drop and first[x] == (r["doc_id"] is None, r["doc_id"] or 0, no))]
        want.append((r["doc_id"], "\n".join(kept)))
    out = lines.without_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))
    assert len(drop) > 10
    assert lines.without_duplicates(df.limit(0)).count() == 0


def test_line_plan_has_no_python(spark):
    plan = lines.dedup(docs(spark, random_texts(4, 5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None
