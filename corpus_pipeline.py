"""Corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Nulls and empty texts: the first stage
rejects documents without a letter, so none reaches the later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opledger.llm import decontaminate, langid, ngrams, packing, secrets
from opledger.llm.common import discard, kept, sided, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language go on; those without a letter, or with no language that holds 0.4 of their letters, go."""
    return langid.accept(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: that with the smallest id, then the smallest hash of its text (five words, similarity 0.8).

    A group is a set of texts, so rows of one id may belong to several and each
    group keeps its own; of rows with the same id and text one stays, that with
    the least other columns.  Texts without a word are linked with nothing and stay.
    """
    rows = kept(ngrams.classes(docs, k=5, num=80, den=100).filter("component is not null").select("component", "doc_id", "digest"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    heads = rows.groupBy("component").agg(F.min(order).alias("head")).select(F.col("head.doc_id").alias("own_id"), F.col("head.digest").alias("own_digest"))
    texts = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    same = texts.doc_id.eqNullSafe(heads.own_id) & (texts.digest == heads.own_digest)
    marked = kept(texts.join(heads, same, "left").select(texts.doc_id.alias("own_id"), texts.digest.alias("own_digest"), "n", heads.own_digest.isNotNull().alias("head")), "marked")
    own = docs.doc_id.cast("bigint").eqNullSafe(F.col("own_id")) & (F.xxhash64(docs.text.cast("string")) == F.col("own_digest"))
    lost, repeated = (kept(marked.filter(which).select("own_id", "own_digest"), name) for which, name in (("not head", "lost"), ("head and n > 1", "repeated")))
    stay = docs.join(sided(lost), own, "left_anti")
    if not repeated.isEmpty():
        again, names = sided(repeated), [c for c in docs.columns if c not in ("doc_id", "text")]
        first = stay.join(again, own, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*names)).alias("first"))
        stay = stay.join(again, own, "left_anti").unionByName(first.select("doc_id", "text", *[F.col("first")[c].alias(c) for c in names]).select(*docs.columns))
    discard(rows, marked)
    return stay


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, decontaminate.load(table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("packed", packed),
]
#: Neither trained models nor tokenizers can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
