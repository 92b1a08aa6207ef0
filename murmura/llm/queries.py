"""One query for each operator of this subpackage, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, best_fit, byte_bpe, fagin, hamming_dedup, huffman, kn_quality, language_id, license_scan, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS m FROM p GROUP BY x)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM p JOIN f USING (x)
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    back = byte_bpe.recode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=75)


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fagin.top_products(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


#: Rows have numbers, so that rows that repeat a vec_id are queries and candidates of their own.
OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.n <> q.n AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write_ids(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)
    return huffman.read_ids(spark, path, checksums=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_language, op3_warc, op4_nearest, op5_quality, op6_best_fit, op7_byte_bpe, op8_near_duplicates, op9_top_products, op10_huffman)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": license_scan.scan_sql(), "op3_warc": OP3_SQL, "op9_top_products": OP9_SQL}
