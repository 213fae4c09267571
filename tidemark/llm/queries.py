"""The opN_ queries, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, gru_lm, minhash_dedup, mixing, pii, quality, sentencepiece_bpe, substring_dedup, tiff, url_filter
from .common import staged, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.mined(url_filter.labelled_pages(spark, sf_dir))
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    spans = spans.withColumn("base", F.expr(f"filter(found, x -> x.rank < {len(pii.BASE)})"))
    return spans.select(
        "doc_id",
        *(F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE),
        F.sha2(F.expr(pii.joined("base")), 256).alias("base_sha256"),
        F.expr(pii.joined("found")).alias("spans"),
        F.expr("transform(found, x -> x.score)").alias("scores"),
    )


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.encode_texts(table(spark, sf_dir, "documents"), predictor=tiff.HORIZONTAL)
    files = files.select("id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    found = tiff.decode_pages(files, keep=("id", "n_bytes", "media_bytes", "media_sha256"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("raster").cast("long").alias("payload_bytes"),
        F.sha2("raster", 256).alias("payload_sha256"),
        F.crc32(F.substring("raster", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%dx%d:%d:%d:%s%d:%.6f:%.6f", "width", "height", "samples", "compression", "predictor", "layout", "parts", "mean", "deviation").alias("feature"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "shard", "shards")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.language_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what travels of each text is its digest; the operator itself gives the words
    rows, cut = substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("id", "key", "n_words", F.sha2("words", 256).alias("whole"))
    cut = staged(cut.select("key", "n_removed", F.sha2("kept", 256).alias("rest")).dropDuplicates(["key"]), "cut")
    return rows.join(cut, "key", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("rest", "whole").alias("kept_sha256")
    )


def piece_model() -> str:
    """The vocabulary file: TIDEMARK_PIECE_MODEL, else the one installed beside the tokenizer libraries."""
    if not (path := os.environ.get("TIDEMARK_PIECE_MODEL")):
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), piece_model())
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_pii": op3_pii,
    "op4_tiff_pages": op4_tiff_pages,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_gru_lm": op7_gru_lm,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op1_url_filter": r"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, url, coalesce(rest, '') AS rest FROM p)),
k AS (SELECT *, list_distinct(list_filter(
        ['scheme:' || lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), 'host:' || host]
        || list_transform(string_split(host, '.'), lambda x: 'label:' || x)
        || list_transform(string_split(path, '/'), lambda x: 'path:' || regexp_replace(x, '^[0-9]+', '0'))
        || list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: 'query:' || split_part(x, '=', 1)), lambda x: x NOT LIKE '%:')) AS own FROM h),
b AS (SELECT row_number() OVER () AS r, own, CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 'block' ELSE 'allow' END AS label
      FROM k JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL),
classes AS (SELECT label, count(*) AS own, sum(count(*)) OVER () AS total, count(*) OVER () AS several FROM b GROUP BY label),
need AS (SELECT greatest(10, ceil(0.002 * count(*))) AS need FROM b),
o AS (SELECT token, count(*) AS n, md5(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r)) AS urls
      FROM (SELECT r, unnest(own) AS token FROM b) GROUP BY token HAVING count(*) >= (SELECT need FROM need)),
f AS (SELECT min(token) AS item FROM o GROUP BY urls),
t AS (SELECT r, label, token AS item FROM (SELECT r, label, unnest(own) AS token FROM b) JOIN f ON item = token),
c AS (SELECT [item] AS tokens, label FROM t
      UNION ALL SELECT [x.item, y.item], x.label FROM t AS x JOIN t AS y ON x.r = y.r AND x.item < y.item
      UNION ALL SELECT [x.item, y.item, z.item], x.label FROM t AS x JOIN t AS y ON x.r = y.r AND x.item < y.item JOIN t AS z ON x.r = z.r AND y.item < z.item),
g AS (SELECT tokens, label, count(*)::DOUBLE AS hits, sum(count(*)) OVER (PARTITION BY tokens)::DOUBLE AS n FROM c GROUP BY tokens, label),
v AS (SELECT tokens, label AS verdict, hits, n, own, total, hits / n AS share, round(hits / own / (hits / own + (n - hits) / (total - own)), 9) AS confidence
      FROM g JOIN classes USING (label) WHERE several > 1 AND hits >= (SELECT need FROM need)),
w AS (SELECT tokens, verdict, confidence, hits / total AS support, array_to_string(tokens, ' ') AS association FROM v
      WHERE confidence >= 0.6 AND (share + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(share * (1 - share) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n) > own::DOUBLE / total),
rules AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w AS u WHERE u.verdict = w.verdict AND len(u.tokens) < len(w.tokens) AND u.confidence >= w.confidence AND list_has_all(w.tokens, u.tokens))),
m AS (SELECT DISTINCT ON (url) url, verdict, confidence, association
      FROM (SELECT DISTINCT url, own FROM k WHERE url IS NOT NULL) JOIN rules ON list_has_all(own, tokens)
      ORDER BY url, confidence DESC, support DESC, association, verdict),
d(says, rule, dom, start) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
l AS (SELECT host, path, max_by(struct_pack(rule := rule, says := says), len(rule)) AS best
      FROM (SELECT DISTINCT host, path FROM h) JOIN d ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, start) GROUP BY host, path)
SELECT k.page_id, k.host, k.path, l.best.rule AS rule, coalesce(l.best.says, m.verdict, 'allow') AS verdict, m.confidence AS confidence, m.association AS association
FROM k LEFT JOIN l ON l.host = k.host AND l.path = k.path LEFT JOIN m ON m.url = k.url""",
    "op2_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) FILTER (g.i IS NULL) AS rest, count(g.i) AS gone
      FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS points FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
}
