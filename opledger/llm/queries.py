"""Queries over the operators of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lm, media, ngrams, packing, secrets, sstable, urls, warc
from .common import held_out, scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    model = langid.train(docs.filter(~out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


def op2_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.read_features(stored).drop("clips")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.load(table(spark, sf_dir, "benchmark"))
    return decontaminate.leaks(table(spark, sf_dir, "documents"), items)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(warc.decide(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_media_clips, op3_token_shards, op4_url_filter, op5_packing, op6_decontamination, op7_lm_score, op8_warc, op9_secret_scan, op10_ngram_join)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest""",
    "op10_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.r = l.a)
SELECT c.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
}
