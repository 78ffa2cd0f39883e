import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.data import odd, random_texts
from tokenizers import Tokenizer

from webrel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"


def check(rows, docs, length):
    """Every id in one piece, digests right, offsets gapless, little padding; the number of cuts inside tails."""
    coder = Tokenizer.from_file(PATH)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r["id"], []).append(r)
    assert set(pieces) == set(want)
    for i, texts in want.items():
        assert sorted(s for t in texts for s in [len(t)]) == sorted(
            s for s in [len(t) for t in texts] if any(r["tokens"] == s for r in pieces[i]))
        covered = sorted((r["start"], r["length"], r["crc"]) for r in pieces[i])
        if len(texts) == 1 or all(len(t) == len(texts[0]) and (t == texts[0]).all() for t in texts):
            at = 0
            for start, n, crc in covered[::1] if len(texts) == 1 else []:
                assert start == at and crc == zlib.crc32(texts[0][start:start + n])
                at += n
            assert sum(n for _, n, _ in covered) == sum(map(len, texts))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding, len(sequences)


@pytest.mark.parametrize("length", [64, 2048])
def test_every_id_once(spark, length):
    texts = random_texts(5, 150) + ["x" * 5000, "word " * 3000, "<|endoftext|> a<|endoftext|>", " é  日本語\x85\x1c z"]
    docs = odd(spark, texts)
    rows = packing.pack(docs, PATH, length=length).collect()
    padding, n = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], length)
    assert padding == 0
    assert n <= sum(r["length"] for r in rows) / length + 12


def test_empty_table_and_one_length(spark):
    none = odd(spark, ["a"]).where("false")
    assert packing.pack(none, PATH).count() == 0
    same = spark.createDataFrame([(i, "the same words") for i in range(300)], "doc_id long, text string")
    rows = packing.pack(same, PATH).collect()
    assert check(rows, [(i, "the same words") for i in range(300)], 2048)[0] == 0


def test_plan_uses_every_tail_once():
    rng = np.random.default_rng(1)
    for length, n in ((64, 500), (64, 7), (2048, 60_000)):
        histogram = {int(s): int(c) for s, c in zip(*np.unique(rng.integers(1, length, n), return_counts=True), strict=True)}
        slots, line, packed, total = packing.plan(histogram, length)
        filled = [0] * packed
        taken = {}
        for tail, lo, hi, times, first, offset in slots:
            assert (hi - lo) % times == 0
            for rank in range(lo, hi):
                taken[tail, rank] = taken.get((tail, rank), 0) + 1
                filled[first + (rank - lo) // times] += tail
        for tail, lo, _ in line:
            for rank in range(lo, histogram[tail] + 1):
                taken[tail, rank] = taken.get((tail, rank), 0) + 1
        assert taken == {(s, r): 1 for s, c in histogram.items() for r in range(1, c + 1)}
        assert all(f & (f - 1) == 0 for f in filled)        # full, or closed at a power of two
        assert total == sum(s * c for s, c in histogram.items()) - sum(filled)
    assert total < 0.1 * sum(s * c for s, c in histogram.items())


def test_knapsack_against_enumeration():
    sizes, values = np.array([3, 5, 7]), np.array([2.0, 4.5, 5.0])
    best, last = packing.price(values, sizes, 20)
    for c in range(21):
        sums = [2.0 * a + 4.5 * b + 5.0 * d for a in range(7) for b in range(5) for d in range(3) if 3 * a + 5 * b + 7 * d == c]
        assert best[c] == (max(sums) if sums else -np.inf)
        if c and sums:
            assert sum(int(sizes[k]) * t for k, t in packing.fill(c, last, sizes).items()) == c


def test_linear_program_reaches_the_bound():
    """Two of 5 and three of 3 fill 10 and 9: the program finds the mix that fills 16 exactly."""
    found = packing.patterns(np.array([3, 5]), np.array([200, 200]), 16)
    assert all(sum([3, 5][k] * t for k, t in p.items()) in (1, 2, 4, 8, 16) for p, _ in found)
    assert sum(v * sum([3, 5][k] * t for k, t in p.items()) for p, v in found) > 0.95 * 1600


def test_cuts_of_a_line():
    assert packing.cuts(0, 10, 10, 16) == [(0, 8, 0, 0), (8, 2, 1, 0)]
    assert packing.cuts(12, 10, 41, 16) == [(0, 4, 0, 12), (4, 6, 1, 0)]
    assert packing.cuts(30, 11, 41, 16) == [(0, 2, 1, 14), (2, 8, 2, 0), (10, 1, 3, 0)]
