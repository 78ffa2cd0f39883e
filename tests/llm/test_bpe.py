import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webrel.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  a  b \n\n c\t", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "é ß 日本語 🙂👍🏽 ‍",
       "it's we'll I'VE 12 345", "\x00\x01\x1c \x85 　z", "ab" * 300, "aaaaaaaaaa" * 60, " " * 500 + "x", "1" * 700,
       "́́á", "\U000e0001�﻿"]


@pytest.fixture(scope="module")
def both():
    return bpe.Coder(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


def ids_of(coder, text):
    return [i for block in coder.blocks(text) for i in block]


def test_same_as_library(both):
    coder, lib = both
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x370, 0xd7ff),
                                          rng.randrange(0x1f300, 0x1f700), 32, 10])) for _ in range(rng.randrange(1, 60)))
                   for _ in range(1500)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids_of(coder, t) == want, repr(t)
        assert coder.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_long_word_heap_equals_array(both):
    coder, _ = both
    rng = random.Random(2)
    for n in (130, 200, 400):
        word = [coder.first[b] for b in "".join(rng.choice("abcde the") for _ in range(n)).encode()]
        short = bpe.SHORT
        try:
            bpe.SHORT = 10 ** 9
            plain = bpe.merge_word(list(word), coder.merges)
        finally:
            bpe.SHORT = short
        assert plain == bpe.merge_word(list(word), coder.merges)


def test_undecodable_ids(both):
    coder, lib = both
    half = lib.encode("é🙂", add_special_tokens=False).ids[:-1]
    assert coder.decode(half) == lib.decode(half, skip_special_tokens=False)


def test_column(spark, both):
    _, lib = both
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, None), (3, "twice", "x"), (3, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = df.select("doc_id", "text", bpe.encode(spark, "text", PATH).alias("t"))
    out = out.select("doc_id", "text", "t", bpe.decode(spark, "t", PATH).alias("d")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r["t"]) == lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["d"] == (r["text"] or "")
    none = df.limit(0).select(bpe.decode(spark, bpe.encode(spark, "text", PATH), PATH).alias("d"))
    assert none.collect() == []


def test_round_trip_equals_encode_and_decode(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Ein  Wort\n", "äöü 😀 <|endoftext|> x", *[f"row {i} of many" for i in range(2 * bpe.ROWS + 3)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    plain = docs.select("i", bpe.encode(spark, "text", path).alias("ids")).select("i", "ids", bpe.decode(spark, "ids", path).alias("decoded"))
    both = docs.select("i", bpe.round_trip(spark, "text", path).alias("b")).select("i", "b.ids", "b.decoded")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, plain.collect()))
