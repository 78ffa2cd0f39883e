import hashlib
import re

from pyspark.sql import functions as F

from webrel.llm import exact, mixing

from .data import docs, odd, random_texts


def test_exact_against_brute_force(spark):
    texts = random_texts(1, 30)
    df = odd(spark, texts + [t.replace(" ", " \n\t") for t in texts[:10]] + texts[5:8])
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in df.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    order = lambda i: (i is None, i or 0)
    want = []
    for t, ids in groups.items():
        keep = min(ids, key=order)
        for k, i in enumerate(sorted(ids, key=order)):
            want.append((i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact.dedup(df).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact.dedup(df.limit(0)).count() == 0


def test_targets_are_shared_until_none_is_above(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), ("d", 500), (None, 50), ("e", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(["a", "b", "c", "d", "e", None])}
    size, total = dict(sizes), sum(n for _, n in sizes)
    target, capped = {}, set()
    while True:
        free = [s for s in size if s not in capped]
        left = total - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in size}
        above = [s for s in free if target[s] > 3 * size[s]]
        if not above:
            break
        capped.update(above)
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in target.items()}


def test_mix_is_near_its_targets_and_repeats(spark):
    df = docs(spark, random_texts(2, 400, 1, 40), ["a", "b", "b", "b", "c", "c", "c", "c", None])
    first = {r["id"]: r for r in mixing.mix(df).collect()}
    again = {r["id"]: r for r in mixing.mix(df.orderBy(F.rand(3)).repartition(5)).collect()}
    assert first == again
    taken, target = {}, {}
    for r in first.values():
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 80 for s in taken)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in first.values())


def test_mix_of_odd_rows(spark):
    df = odd(spark, random_texts(3, 20))
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    assert all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert len({r["copies"] for r in got if r["id"] == 0}) == 1
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    nothing = docs(spark, ["", " ", None])
    assert [r["copies"] for r in mixing.mix(nothing).collect()] == [0, 0, 0]
