import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from webrel.llm import minhash, mixing, toxicity

from .test_minhash import brute_classes

SF = "/root/testdata/sf0.001"


def test_every_stage_against_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
            p = {r[0]: r[1] for r in before.select("doc_id", toxicity.score(spark, model, "text")).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {i for i, v in p.items() if v < 0.3}
        elif name == "line_dedup":
            assert docs.count() == before.count()
        elif name == "minhash":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {eval(c)[1] for c in classes}  # noqa: S307
            assert minhash.classes(docs).where("class_size > 1").count() == 0
        elif name == "mixing":
            copies = {r["id"]: r["copies"] for r in mixing.mix(before).collect()}
            got = {}
            for r in docs.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {i: n for i, n in copies.items() if n}
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
            for r in docs.collect():
                ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["n_tokens"] == len(ids)
                assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
