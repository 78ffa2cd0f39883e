import math
import random

import pytest
from pyspark.sql import functions as F

from webrel.llm import topk


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(10_000, 20_000), (60, 20_000), (60, 3)])
def test_against_brute_force(spark, shard_rows, query_rows):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(k % 5, 1) for _ in range(6)]) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(30)]           # one very common vector: ties
    rows += [(500, [1.0] * 4), (600, [2.0] * 4), (601, [0.5] * 4)]   # another length
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    rows += [(700, None), (800, [math.nan] * 6), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, [math.inf] * 6), (1100, []),
             (None, [9.0] * 6), rows[0], rows[50]]               # no part; repeated rows
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id bigint, embedding array<double>, id string, shard int")
    want = []
    for q, v in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:10])]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sums_beyond_float_precision(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**9, 3.0]), (2, [2.0**9, 4.0]), (3, [-1.0, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2**59 + 2**22), (1, 2**59 + 3 * 2**20)]
