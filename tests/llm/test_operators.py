"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from opledger.llm import decontaminate, langid, lm, media, ngrams, packing, queries, secrets, sstable, urls, warc
from opledger.llm.subwords import WordEncoder, vocabulary_path
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def table(data):
    return pq.read_table(f"{data}/documents.parquet").to_pydict()


@pytest.fixture(scope="module")
def library():
    return WordEncoder(vocabulary_path()).library


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, data, name):
    found, wanted = queries.QUERIES[name](spark, data), duck.execute(queries.ORACLE[name]).df()
    names = sorted(wanted.columns)
    assert sorted(found.columns) == names and rows_of(found.toPandas(), names) == rows_of(wanted, names)


def test_encoder_equals_library(library):
    r = random.Random(4)
    bits = list("ab c d  \n\t.,'!é😀1 2 　ſ-") + ["don't", "the ", " x", "'s", " \n", "\n ", "日本", "\x85", " \x1c", "words, ", "More "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(3000)] + ["", None, " ", "a ", "\n"]
    small = WordEncoder(vocabulary_path(), remembered=50)
    for at in range(0, len(texts), 300):
        got = small.encode(texts[at:at + 300])
        for t, g in zip(texts[at:at + 300], got):
            assert np.frombuffer(g, "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids


# 1


def test_language_held_out_accuracy(spark, data):
    found = queries.op1_language_id(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    r = found.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


def test_best_path_is_the_best_of_all():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(60):
        s = r.normal(size=(5, 3)) * 2
        value = lambda p: sum(s[i, c] for i, c in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert math.isclose(value(langid.best_path(s, 1.5).tolist()), max(map(value, itertools.product(range(3), repeat=5))))


def test_mixed_text_has_spans(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    en, de = (next(r.text for r in docs.filter((F.col("lang") == x) & (F.length("text") > 400)).orderBy("doc_id").limit(3).collect())[:400] for x in ("en", "de"))
    (_, _, spans), = langid.label([en + "\n" + de], model)
    assert spans[0][2] == "en" and spans[-1][2] == "de" and abs(spans[-1][0] - 400) < 40


# 2


def test_media_round_trip_and_general_decoder():
    r = random.Random(2)
    payloads = [media.padded(r.randbytes(n)) for n in (0, 1, 64, 65, 4096, 4160, 20000)]
    for p, f, (head, frames) in zip(payloads, media.write_avis(payloads), media.decode_avis(media.write_avis(payloads))):
        assert b"".join(x.tobytes() for x in frames)[:head["payload"]] == p
        at, size = head["frames"][0]
        assert (media.decode_frame(f[at:at + size]) == frames[0]).all()
        cut = f[:f.rindex(b"idx1")]
        cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
        assert media.parse_avi(cut)["frames"] == head["frames"]
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF1234WAVE")


def test_baseline_frame_is_decoded():
    """A grey frame of two blocks: DC differences 16 and -32 at quantiser 4, no AC."""
    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    dc = bytes([0, 0, 2] + [0] * 13) + bytes([5, 6])  # codes 000? lengths: two codes of three bits
    ac = bytes([1] + [0] * 15) + bytes([0])  # end of block: one bit
    bits = "000" + "10000" + "0" + "001" + "011111" + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([4] * 64)) + segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + segment(0xC4, b"\0" + dc) + segment(0xC4, b"\x10" + ac) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    got = media.decode_frame(frame)
    assert (got[:, :8] == 128 + 16 * 4 // 8).all() and (got[:, 8:] == 128 + (16 - 32) * 4 // 8).all()


def test_shots():
    dark, light = np.full((8, 8), 10, np.uint8), np.full((8, 8), 200, np.uint8)
    assert media.shots([dark] * 4 + [light] * 3 + [dark]) == [(0, 3), (4, 6), (7, 7)]
    assert media.shots([]) == [] and media.shots([dark]) == [(0, 0)]


def test_media_query(spark, data, table):
    got = {r.doc_id: r for r in queries.op2_media_clips(spark, data).collect()}
    for i, t in zip(table["doc_id"], table["text"]):
        raw = (t or "").encode()
        p = media.padded(raw)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


# 3, 5


def test_shards_query_and_lookup(spark, data, table, library, tmp_path):
    manifest = sstable.write_shards(spark.read.parquet(f"{data}/documents.parquet"), f"{tmp_path}/s")
    got = {r.doc_id: r for r in sstable.read_shards(manifest).collect()}
    at, texts = 0, dict(zip(table["doc_id"], table["text"]))
    for i in sorted(texts):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wanted = spark.createDataFrame([(3,), (10**9,), (7,)], "doc_id bigint")
    found = {r.doc_id: r.tokens for r in sstable.lookup(manifest, wanted).collect()}
    assert found == {i: library.encode(texts[i], add_special_tokens=False).ids + [2] for i in (3, 7)}


def test_damaged_shard_is_noticed(tmp_path):
    w = sstable.ShardWriter(f"{tmp_path}/a.sst")
    for i in range(100):
        w.add(sstable.id_key(i), bytes([i]) * 50, 25)
    w.close()
    raw = bytearray((tmp_path / "a.sst").read_bytes())
    raw[20] ^= 1
    (tmp_path / "b.sst").write_bytes(raw)
    assert [k for k, _ in sstable.Shard(f"{tmp_path}/a.sst")] == [sstable.id_key(i) for i in range(100)]
    with pytest.raises(ValueError):
        list(sstable.Shard(f"{tmp_path}/b.sst"))


def test_tournament_is_first_fit():
    r = random.Random(8)
    tree, rooms = packing.Tournament(100), []
    for _ in range(500):
        n = r.randrange(1, 101)
        at = next((i for i, x in enumerate(rooms) if x >= n), len(rooms))
        if at == len(rooms):
            rooms.append(100)
        rooms[at] -= n
        assert tree.place(n) == at


def test_packing_query(spark, data, table, library):
    pieces = queries.op5_packing(spark, data).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in zip(table["doc_id"], table["text"])}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == p.length
    for i, all_ids in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(all_ids)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


# 4


def test_url_rules_by_brute_force(spark, data):
    got = urls.judge(spark.read.parquet(f"{data}/pages.parquet")).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in got:
        rest = pages[r.page_id].partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(rule), rule, v) for v, rule in urls.RULES if (host.lower() == rule.partition("/")[0] or host.lower().endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        assert (r.host, r.path) == (host.lower(), path) and r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_trees_learn():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = urls.Trees().fit(x[:400], y[:400]).probability(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9


# 6


def test_leaks_are_found_and_clean_texts_left(spark, data, table):
    benchmark = pq.read_table(f"{data}/benchmark.parquet").to_pydict()
    items = decontaminate.Items(list(zip(benchmark["item_id"], benchmark["text"])))
    found = {(i, s[0]) for i, f in zip(table["doc_id"], items.search(table["text"])) for s in f}
    fold = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    wanted = {(i, b) for i, t in zip(table["doc_id"], table["text"]) for b, x in zip(benchmark["item_id"], benchmark["text"]) if fold(x) in fold(t)}
    assert wanted <= found
    for i, b in found - wanted:  # near ones hold up against a plain edit distance
        raise AssertionError(f"{i} is not known to hold {b}")
    r = random.Random(6)
    for _ in range(60):
        text = list(r.choice(benchmark["text"]))
        for _ in range(int(len(text) * 0.05)):
            at = r.randrange(len(text))
            text[at:at + r.randrange(2)] = r.choice(["", "q", "w"])
        assert items.search(["Before it. " + "".join(text) + " And after."])[0]
    query = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, data).collect()}
    assert query == found


def plain_edits(a, b):
    """Fewest edits between a and any part of b."""
    rows = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(rows[j] + (x != y), rows[j + 1] + 1, new[-1] + 1))
        rows = new
    return min(rows)


def test_banded_edits_equal_plain_edits():
    r = np.random.default_rng(9)
    for _ in range(300):  # a band as wide as everything
        a, b = r.integers(0, 3, r.integers(1, 9)).astype(np.uint32), r.integers(0, 3, r.integers(1, 14)).astype(np.uint32)
        got, s, e = decontaminate.banded_edits(a, b, np.array([-30]), 40, np.array([0]), np.array([len(b)]))
        assert got[0] == plain_edits(a.tolist(), b.tolist()) == plain_edits(a.tolist(), b[s[0]:e[0]].tolist())
    for _ in range(300):  # a band that is just wide enough for a planted match
        m, most = int(r.integers(20, 40)), int(r.integers(1, 4))
        item = r.integers(0, 20, m).astype(np.uint32)
        copy = item.tolist()
        for _ in range(int(r.integers(0, most + 1))):
            at = int(r.integers(0, len(copy)))
            copy[at:at + int(r.integers(0, 2))] = [int(r.integers(0, 20))][:int(r.integers(0, 2))]
        lead = r.integers(30, 40, 7).tolist()
        text = np.array([*lead, *copy, *r.integers(30, 40, 9).tolist()], np.uint32)
        bands = np.array([7 - 2 * most - 1, 7 - most])
        edits, _, _ = decontaminate.banded_edits(item, text, bands, most, np.array([0, 0]), np.array([len(text)] * 2))
        assert edits.min() == min(plain_edits(item.tolist(), text.tolist()), most + 1) or plain_edits(item.tolist(), text.tolist()) > most


def test_near_matches_at_every_edit_count():
    r = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for m in (13, 15, 16, 24, 25, 26, 40, 63, 100, 187, 300):
        item = "".join(r.choice(letters) for _ in range(m))
        items = decontaminate.Items([(1, item)])
        allowed = min(int(decontaminate.RATE * m), m // decontaminate.Q - 1)
        assert items.edits == [allowed]
        for k in range(allowed + 1):
            for _ in range(6):
                text = list(item)
                for at in sorted(r.sample(range(m), k), reverse=True):
                    text[at:at + r.randrange(2)] = r.choice(["", "A", "7"])
                body = "".join(text)
                if plain_edits(item, body.lower()) <= allowed:
                    found = items.search([f"Before it 1 2 3 {body} 4 5 6 and after."])[0]
                    assert found and found[0][0] == 1 and found[0][3] <= allowed, (m, k, body)
        far = "".join(c if i % 6 else "#" + c for i, c in enumerate(item))
        if plain_edits(item, re.sub("#", " ", far)) > allowed:
            assert items.search([far]) == [[]]


def test_many_shared_grams_are_counted_in_parts(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(400)) + "the passage that all of them share, word by word" for _ in range(6)]
    rows = [(i, "the passage that all of them share, word by word" + c) for i, c in enumerate("xyz")]
    whole = decontaminate.Items(rows).search(texts)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    monkeypatch.setattr(decontaminate, "BANDS", 2)
    assert decontaminate.Items(rows).search(texts) == whole and all(len(f) == 3 for f in whole)


def test_benchmark_in_blocks_gives_the_same(spark, data):
    docs, benchmark = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one, many = decontaminate.load(benchmark), decontaminate.load(benchmark, most_bytes=9000)
    assert one.blocks == 1 and many.blocks > 1
    assert sorted(map(tuple, decontaminate.leaks(docs, one).collect())) == sorted(map(tuple, decontaminate.leaks(docs, many).collect()))
    assert {r.doc_id for r in decontaminate.clean(docs, one).collect()} == {r.doc_id for r in decontaminate.clean(docs, many).collect()}


# 7


def test_base_scores_by_brute_force(spark, data, table):
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(f"{data}/documents.parquet"), queries.held_out("doc_id", 7, 2), hot=300).collect()}
    tokens = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in zip(table["doc_id"], table["text"])}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_windows_score_every_place_once_with_context():
    lengths = np.array([1, 31, 32, 33, 56, 57, 200])
    start, score, end = lm.windows(lengths)
    seen = Counter(p for a, b in zip(score, end) for p in range(a, b))
    assert sorted(seen) == list(range(lengths.sum())) and set(seen.values()) == {1}
    assert all(b - a in (0, lm.OVERLAP) for a, b in zip(start, score)) and (end - start <= lm.WINDOW).all()


def test_attention_is_causal_and_learns():
    net = lm.Attention(classes=5)
    r = np.random.default_rng(0)
    rows = r.integers(0, lm.ROWS, (2, lm.WINDOW))
    other = rows.copy()
    other[:, 20:] = 7
    t = np.zeros((2, lm.WINDOW), np.int64)
    assert np.allclose(net.log_probability(rows, t)[:, :20], net.log_probability(other, t)[:, :20], atol=1e-5)
    state, losses = {"t": 0}, []
    for _ in range(150):
        x = r.integers(0, 5, (16, lm.WINDOW))
        target = np.concatenate([x[:, :1], x[:, :-1]], 1)  # the token before: only attention can see it
        losses.append(net.step(x, target, np.ones(x.shape, np.float32), state, 0.03))
    assert losses[-1] < losses[0] * 0.6


def small_net(r, size=300):
    counts = np.zeros(lm.IDS, np.int64)
    counts[: size - 20] = r.integers(1, 1000, size - 20)
    place, begins, classes, share = lm.class_table(counts, size)
    net = lm.Attention().with_subwords(begins, share, size - 20)
    net.w["v"] += r.standard_normal(net.w["v"].shape).astype(np.float32)
    return net, place, begins, classes, share


def test_scores_equal_a_plain_loop():
    r = np.random.default_rng(3)
    net, place, begins, classes, share = small_net(r)
    end, texts = 299, [r.integers(0, 299, n).astype("<u2") for n in (0, 1, 30, 31, 32, 55, 56, 140)]
    w = {k: x.astype(np.float64) for k, x in net.w.items()}

    def place_score(before, wanted):
        """One place from the ids that stand before it in its window."""
        x = w["e"][net.rows(np.array(before))] + w["p"][: len(before)]
        q, k, v = np.split(x @ w["qkv"], 3, axis=1)
        a = np.exp(q[-1] @ k.T / math.sqrt(lm.WIDTH))
        h = x[-1] + (a / a.sum()) @ v @ w["o"]
        first = np.exp(h @ w["u"] + w["b"])
        c = classes[place[wanted]]
        lo, hi = begins[c], begins[c + 1]
        inner = np.exp(share[lo:hi] + np.array([w["v"][p] @ h if p < len(w["v"]) else 0.0 for p in range(lo, hi)]))
        return math.log10(first[c] / first.sum()) + math.log10(inner[place[wanted] - lo] / inner.sum())

    def plain(ids):
        ids, step = [*ids.tolist(), end], lm.WINDOW - lm.OVERLAP
        before = [end, *ids[:-1]]
        return sum(place_score(before[step * max(0, (i - lm.OVERLAP) // step):i + 1], ids[i]) for i in range(len(ids)))

    got = lm.score_ids([t.tobytes() for t in texts], net, place, classes, end, chunk=3, block=50)
    assert np.allclose(got, [plain(t) for t in texts], rtol=1e-4)


def test_gradients_are_those_of_the_loss():
    import copy

    r = np.random.default_rng(4)
    net, place, _, classes, _ = small_net(r)
    rows, wanted = r.integers(0, lm.ROWS, (6, lm.WINDOW)), place[r.integers(0, 300, (6, lm.WINDOW))]
    weight = (r.random(wanted.shape) < 0.8).astype(np.float32)
    loss = lambda n, state: n.step(rows, classes[wanted], weight, state, 1e-9, wanted)
    state = {"t": 0}
    loss(copy.deepcopy(net), state)
    for name in ("e", "p", "qkv", "o", "u", "b"):
        g = state[name][0] / 0.1  # the first mean holds a tenth of the gradient
        far, sides = 0.02 / np.linalg.norm(g), []
        for sign in (1, -1):
            moved = copy.deepcopy(net)
            moved.w[name] += np.float32(sign * far) * g
            sides.append(loss(moved, {"t": 0}))
        assert math.isclose((sides[0] - sides[1]) / (2 * far), float((g * g).sum()), rel_tol=0.03), name


# 9


def test_secret_spans_by_plain_patterns(spark, data, table):
    got = {r.doc_id: r for r in secrets.scan(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for i, t in zip(table["doc_id"], table["text"]):
        spans = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A):
            if len(m[2]) >= 8:
                spans.append((m.start(), 0, m.end()))
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_guess_costs():
    cost = lambda v: secrets.guess_cost(v)[0]
    assert cost("password123") < 5 and cost("aaaaaaaaaaaa") < 5 and cost("qwertyuiop") < 5 and cost("2021-05-06") < 6
    assert cost("Xk9#mQ2$vLp8") > 15 and cost("z" * 4 + "Xk9#mQ2$" * 40) > 50
    base, added = secrets.spans_of("user says pwd: Xk9#mQ2$vLp8, secret=short, token = abcdefgh12")
    assert [s[1] for s in base] == [0] and [s[1] for s in added] == [3]


# 8, 10


def test_archives_are_gzip_members(spark, data):
    import gzip

    index = warc.write_archives(warc.decide(spark.read.parquet(f"{data}/pages.parquet")), queries.scratch(spark, "w"))
    some = index.filter("page_id = 3")
    assert [r.page_id for r in warc.read_records(some).collect()] == [3]
    r = some.first()
    raw = open(r.archive, "rb").read()[r.offset:r.offset + r.length]
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets, name = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                name[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_join_equals_brute_force(spark, table, k, num, den):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = list(zip(table["doc_id"], table["text"]))
    seeds = [[r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 14, 30, 80]))] for _ in range(25)]
    for _ in range(220):  # chains of small changes, on both sides of the threshold
        words = list(r.choice(seeds))
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        seeds.append(words)
        rows.append((1_000_000 + len(rows), " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngrams.join(spark.createDataFrame(rows, "doc_id bigint, text string"), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_trees_in_parts(spark, monkeypatch):
    """Parts of few points: those left apart meet every part, and all components are found."""
    monkeypatch.setattr(ngrams, "BLOCK", 20)
    r = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(60)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngrams.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_tree_search_finds_all():
    r, rule = np.random.default_rng(4), ngrams.Rule(80, 100)
    points = np.concatenate([r.poisson(3, (300, 64)), r.poisson(3, (30, 64)).repeat(3, 0)]).astype(np.uint16)
    sizes = points.sum(1, dtype=np.int64)
    tree = ngrams.RTree(points, sizes, rule)
    for i in range(0, len(points), 7):
        wanted = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= rule.least_overlap(sizes, sizes[i]))
        assert sorted(tree.search(i).tolist()) == wanted.tolist()
