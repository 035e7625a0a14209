"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opledger.llm import decontaminate, langid, lm, media, ngrams, packing, secrets, sstable, urls, warc
from opledger.llm.common import held_out, scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, node string, row string, ids string, key string"
WORDS = "the quick brown fox jumps over one lazy dog and runs through seven green fields until night falls on them all"
LONG = " ".join(f"{WORDS} {i}" for i in range(3000))


def rows():
    texts = [None, "", "   \n", "12 345", WORDS, WORDS, WORDS + " again", "x", LONG, LONG, "password = Xk9mQ2vLp8zz", "Größe über alles ist schön und gut für mich"]
    made = [(i, t, "de" if t and "ö" in t else "en" if t else None, "s", 0 if t is None else len(t), "n", "node", "row", "ids", "key") for i, t in enumerate(texts)]
    return made + [made[4], (None, WORDS, "en", "s", 1, "n", "node", "row", "ids", "key")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def everything(spark, docs):
    train = langid.train(docs)
    benchmark = spark.createDataFrame([(1, WORDS + " and more of it"), (2, None), (3, "")], "item_id bigint, text string")
    return {
        "language": langid.identify(docs, train), "accept": langid.accept(docs, train), "media": media.read_features(media.store_texts(docs)),
        "shards": sstable.round_trip(spark, docs), "packing": packing.pack_documents(docs), "leaks": decontaminate.leaks(docs, decontaminate.load(benchmark)),
        "clean": decontaminate.clean(docs, decontaminate.load(benchmark)), "lm": lm.score(docs, held_out("doc_id", 7, 2)), "secrets": secrets.scan(docs),
        "redact": secrets.redact(docs), "ngrams": ngrams.join(docs, 4, 85, 100),
    }


def test_empty_tables(spark, none):
    for name, df in everything(spark, none).items():
        assert df.count() == 0, name


def test_odd_rows(spark, docs):
    n = len(rows())
    got = everything(spark, docs)
    for name in ("language", "media", "shards", "lm", "secrets", "redact", "ngrams"):
        assert got[name].count() == n, name
    languages = {r.doc_id: r for r in got["language"].collect()}
    assert all(languages[i].lang_pred == "und" and languages[i].score == 0 for i in (0, 1, 2, 3))
    assert languages[11].lang_pred == "de" and languages[4].lang_pred == "en"
    assert got["accept"].columns == docs.columns and got["accept"].count() == n - 4
    sizes = {r.doc_id: (r.n_bytes, r.payload_bytes) for r in got["media"].collect()}
    assert sizes[0] == sizes[1] == (0, 64) and sizes[8] == (len(LONG), -(-len(LONG) // 64) * 64)
    pieces = got["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.count("*").alias("k")).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows()}
    components = {(r.doc_id, r.component_id) for r in got["ngrams"].collect()}
    assert {(0, 0), (1, 1), (2, 2), (4, 4), (5, 4), (None, 4), (8, 8), (9, 8)} <= components
    scores = {r.doc_id: r for r in got["lm"].collect()}
    assert scores[0].n_tokens == 1 and scores[8].n_tokens == len(LONG.split()) + 1 and scores[0].score == scores[1].score
    assert got["redact"].filter("doc_id = 10").first().text == "[SECRET]"


def test_odd_pages(spark):
    odd = [(1, None, None), (2, "no scheme", "x" * 200), (3, "http://A.Example.COM/en/1?q=1&r=2#f", "x" * 200), (4, "http://a.example.net/de/8x", ""), (4, "http://a.example.net/de/8x", ""), (5, "http://b c\r\n/", "y" * 99), (6, "://", "y" * 99), (None, "http://x.org/es/", "z")]
    pages = spark.createDataFrame(odd, "page_id bigint, url string, html string").withColumn("host", F.lit("h")).withColumn("digest", F.lit("d"))
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[2].host) == ("", "", "") and (got[3].host, got[3].path, got[3].rule) == ("a.example.com", "/en/1", "com/en/")
    assert (got[4].rule, got[4].verdict) == ("example.net/de/8", "block") and got[None].verdict == "block"
    index = warc.write_archives(warc.decide(pages), scratch(spark, "w"))
    back = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index).collect()}
    assert back == {(1, 0, "response", None), (2, 200, "response", None), (3, 200, "revisit", 2), (4, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None), (None, 1, "response", None)}
    assert warc.read_records(index).count() == len(odd)
    empty = pages.limit(0)
    assert urls.judge(empty).count() == 0
    assert warc.read_records(warc.write_archives(warc.decide(empty), scratch(spark, "w"))).count() == 0


def test_stages_on_odd_rows(spark, docs, none, data):
    for start in (docs, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, kept, data)
            if name != "packed":
                assert made.columns == docs.columns, name
                made = spark.createDataFrame(made.collect(), docs.schema)
            kept = made
        assert kept.columns[:3] == ["doc_id", "start", "length"]
        if start is docs:
            assert {r.doc_id for r in kept.select("doc_id").collect()} >= {7, 8, 10, 11}
        else:
            assert kept.count() == 0
