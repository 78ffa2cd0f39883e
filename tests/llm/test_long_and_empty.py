"""Very long texts through the Spark path of each operator, and an empty table through the pipeline."""

import hashlib

import corpus_pipeline
from webrel.llm import exact, lexical, lines, mainpage, minhash, mixing, phrases

from .data import DOC, docs

WORD = [f"w{k % 977}x{k % 13}" for k in range(200_000)]
LONG = " ".join(WORD[:1000]) + "\n" + " ".join(WORD) + "\n" + " ".join(WORD[:1000])


def table(spark):
    return docs(spark, [LONG, "short text of five words", LONG, LONG + " and more", ""])


def test_long_texts(spark):
    df = table(spark)
    sizes = {r["id"]: r["size"] for r in mixing.mix(df).collect()}
    assert sizes[0] == 202_000 and sizes[1] == 5 and sizes[4] == 0
    kept = {r["doc_id"]: r["keep_id"] for r in exact.dedup(df).collect()}
    assert kept == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    group = {r["id"]: r["class_id"] for r in minhash.classes(df).collect()}
    assert group == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4}
    left = {r["row"]["doc_id"]: r["n_removed"] for r in lines.dedup(df).collect()}
    assert left[0] == 1 and left[2] == 3 and left[1] == 0
    found, totals = phrases.frequent(df, least=30)
    assert {r["lang"]: r["n"] for r in totals.collect()} == {"und": 5 + 202_000, "en": 202_000 + 202_002}
    assert found.where("words = 4").count() > 0
    items = spark.createDataFrame([(1, "w5x5 short")], "item_id long, text string")
    assert sorted(r["id"] for r in lexical.search(df, items).collect()) == [0, 1, 2, 3]


def test_long_pages(spark):
    body = "".join(f"<p>{' '.join(WORD[k:k + 50])}</p>" for k in range(0, len(WORD), 50))
    pages = spark.createDataFrame([(1, "http://h/1", f"<html><nav>menu</nav><article>{body}</article></html>"), (2, "http://h/2", body)],
                                  "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in mainpage.extract(pages).collect()}
    want = "\n".join(" ".join(WORD[k:k + 50]) for k in range(0, len(WORD), 50))
    assert {k: hashlib.md5(v.encode()).hexdigest() for k, v in got.items()} == dict.fromkeys((1, 2), hashlib.md5(want.encode()).hexdigest())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
