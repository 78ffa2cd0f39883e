"""Small inputs for the operators' tests."""

import random

DOC = "doc_id bigint, text string, lang string, source string, rid string, id string, row string, score double"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("klmnrst") + rng.choice("aeiouy") for _ in range(n)]


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 3 else "en", (sources or ["s"])[i % len(sources or [0])], "r", "x", None, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd(spark, texts):
    """The same with a null id, null text, empty text, and a row that repeats."""
    base = docs(spark, texts)
    more = spark.createDataFrame([(None, "only a null id here", None, None, None, None, None, None),
                                  (9001, None, None, None, None, None, None, None), (9002, "", "en", "s", "", "", "", 1.0),
                                  (9003, "  \n \t ", "en", "s", "", "", "", 1.0),
                                  (0, texts[0], "en", "s", "r", "x", None, 0.5)], DOC)
    return base.unionByName(more)


def random_texts(seed, n, low=5, high=60):
    rng = random.Random(seed)
    return [" ".join(words(rng, rng.randrange(low, high))) for _ in range(n)]
