"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrel.llm import bpe, exact, lexical, lines, mainpage, minhash, mixing, packing, phrases, repeats, topk, toxicity, warc
from webrel.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(spark, "text", path).alias("ids"))
    docs = docs.select("doc_id", "ids", bpe.decode(spark, "ids", path).alias("decoded"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out()
    model = toxicity.fit(docs, labels.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), toxicity.score(spark, model, "text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register("op3_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER ()
                 - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / nullif(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS level
      FROM w),
f AS (SELECT *, source_size * 3.0::DOUBLE <= level * w AS is_full FROM l),
t AS (SELECT source, source_size, place,
             CASE WHEN is_full THEN source_size * 3.0::DOUBLE
                  ELSE (SELECT arg_min(level, source_size / w) FROM f WHERE NOT is_full) * w END AS target FROM f),
q AS (SELECT d.*, t.source_size, t.target, t.place,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, h, e, (e * source_size + upto)::DOUBLE / nullif(target, 0) AS finish
      FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, place, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM k WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


@register("op4_exact", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
""")
def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op7_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, html FROM p),
g AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * k::INT, 5))::INT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN g USING (html)
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.read(spark, warc.archive(table(spark, sf_dir, "pages"), min_bytes=0))
    return chunks.where("last").select(
        F.col("id").cast("long").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_id").cast("long").alias("refers_to"))


@register("op10_topk", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op9_mainpage")
def op9_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.extract(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size")


@register("op8_lines", r"""
WITH o AS (
  SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
d AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS pos FROM o WHERE trim(line) <> '' GROUP BY line),
w AS (SELECT line, pos, string_split(line, ' ') AS w FROM d),
v AS (SELECT line, pos, w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w WHERE len(w) >= 8),
g AS (SELECT line, pos, i, n, list_concat(w[:i - 1], w[i + 1:]) AS rest FROM v),
near AS (
  SELECT a.line FROM g a JOIN g b ON a.n = b.n AND a.i = b.i AND a.rest = b.rest AND b.pos < a.pos
  UNION SELECT a.line FROM g a JOIN w b ON a.n - 1 >= 8 AND a.rest = b.w AND b.pos < a.pos
  UNION SELECT b.line FROM g a JOIN w b ON a.n - 1 >= 8 AND a.rest = b.w AND a.pos < b.pos),
k AS (SELECT o.doc_id, o.no, o.line,
             d.pos IS NOT NULL AND (d.pos <> struct_pack(d := o.doc_id, n := o.no) OR o.line IN (SELECT line FROM near)) AS gone
      FROM o LEFT JOIN d ON o.line = d.line)
SELECT t.doc_id, CASE WHEN coalesce(t.text, '') = '' THEN 0 ELSE count(k.no) END::BIGINT AS n_lines,
       count(k.no) FILTER (k.gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.no) FILTER (NOT k.gone), '')) AS kept_sha256
FROM documents t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id, t.text
""")
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op2_repeats")
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"),
                         F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


@register("op12_lexical", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT row, count(*) AS n FROM t GROUP BY row),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
m AS (SELECT row, 100 - 25 + (25 * n * docs) // words AS m FROM n, c),
b AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
q AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
s AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@register("op13_phrases", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, k
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.k, x.a, x.cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = list_aggregate(x.w[:x.cut], 'string_agg', ' ')
             JOIN f r ON r.lang = x.lang AND r.phrase = list_aggregate(x.w[x.cut + 1:], 'string_agg', ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, n, unnest(range(1, k - n + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS n FROM c WHERE k > 2)),
h AS (SELECT lang, list_aggregate(w[s:s + n - 1], 'string_agg', ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT z.* FROM z LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * z.a),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang)
WHERE rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
