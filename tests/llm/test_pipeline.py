"""The pipeline's stages against brute-force versions on the smallest tables."""

import re

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from opledger.llm import packing, secrets
from opledger.llm.subwords import WordEncoder, vocabulary_path
from tests.llm.test_operators import brute


def test_stages_by_brute_force(spark, data):
    docs, made = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, data), name)
        made[name] = docs
    rows = {n: {r.doc_id: r for r in made[n].collect()} for n in list(made)[:-1]}
    source = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    letters = {i for i, r in source.items() if re.search(r"[^\W\d_]", r.text or "")}
    assert set(rows["language"]) == letters
    groups = brute([(i, source[i].text) for i in sorted(letters)], 5, 80, 100)
    assert set(rows["near_duplicates"]) == {i for i, (_, c) in groups.items() if c == i}
    fold = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [fold(t) for t in pq.read_table(f"{data}/benchmark.parquet")["text"].to_pylist()]
    clean = {i for i in rows["near_duplicates"] if not any(x in fold(source[i].text) for x in items)}
    assert set(rows["decontaminated"]) == clean
    for i, r in rows["without_secrets"].items():
        assert not any(secrets.spans_of(r.text)[0]) and r.n_chars == len(r.text)
        assert r.text == source[i].text or "[SECRET]" in r.text
    assert set(rows["without_secrets"]) == clean
    library = WordEncoder(vocabulary_path()).library
    sizes = {}
    for p in made["packed"].collect():
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes == {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows["without_secrets"].items()}


def test_run_gives_the_last_stage(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_pack_covers_every_id_once():
    r = np.random.default_rng(5)
    for top in (3, 70, 500):
        lengths = r.integers(1, top, 200).tolist()
        seen = [np.zeros(n, int) for n in lengths]
        padding = 0
        for pieces in packing.pack(lengths, 64):
            n = sum(p[2] for p in pieces)
            assert n <= 64
            padding += 0 if n & (n - 1) == 0 else 64 - n
            for i, s, k in pieces:
                seen[i][s:s + k] += 1
        assert all((x == 1).all() for x in seen) and padding == 0


def test_repeated_ids_with_different_texts_lose_no_text(spark):
    a, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "az")
    near = a + " more"
    made = [(4, a, "en"), (4, z, "en"), (5, a, "en"), (5, near, "en"), (6, z, "de"), (6, z, "en"), (4, z, "aa"), (4, z, "bb"), (None, a, "en"), (None, "only here " + a[::-1], "en"), (None, None, "en"), (7, "", "en"), (7, "", "en")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    found = sorted(((r.doc_id, r.text, r.lang) for r in got), key=str)
    assert found == sorted([(4, a, "en"), (4, z, "aa"), (None, "only here " + a[::-1], "en"), (None, None, "en"), (7, "", "en"), (7, "", "en")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
