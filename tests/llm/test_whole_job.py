"""Operators do the whole job: nothing is sampled, dropped or cut where the result depends on it."""

import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from opledger.llm.common import held_out
from opledger.llm import decontaminate, langid, lm, media, packing, secrets, sstable, urls, warc

# 7


def test_attention_learns_from_every_window_and_tells_subwords_of_a_class_apart(spark):
    end, r = 50_256, np.random.default_rng(2)
    pairs = [np.stack([a := r.integers(300, 302, 60), a + 10], 1).ravel().astype("<u2").tobytes() for _ in range(200)]  # 310 follows 300, 311 follows 301
    counts = np.bincount(np.frombuffer(b"".join(pairs), "<u2"), minlength=lm.IDS)
    counts[end] = len(pairs)
    place, begins, classes, share = lm.class_table(counts, end + 1)
    assert sorted(place[:end + 1]) == list(range(end + 1)) and classes[place[310]] == classes[place[311]]
    assert np.allclose(np.bincount(classes, np.exp(share)), 1)
    net = lm.Attention().with_subwords(begins, share, int((counts > 0).sum()))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(pairs)], "key bigint, ids binary").repartition(3)
    net, seen = lm.fit_all(rows, lm.fit(net, pairs[:20], place, classes, end), place, classes, end, 3)
    assert seen == 200 * 4  # 121 places each
    right, wrong = (np.array([300, x] * 20, "<u2").tobytes() for x in (310, 311))
    a, b = lm.score_ids([right, wrong], net, place, classes, end)
    assert a > b + 10


def test_scores_do_not_depend_on_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(lm, "MEANS", 2)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(120).select("doc_id", "text")
    rows = spark.createDataFrame(docs.collect(), docs.schema)
    one, two = ({r.doc_id: (r.score, r.base_score) for r in lm.score(rows.repartition(n), held_out("doc_id", 7, 2), sample=50).collect()} for n in (2, 7))
    assert set(one) == set(two) and all(np.allclose(one[i], two[i], rtol=1e-4) for i in one)


# 9


def test_values_that_base_spans_cover_in_part_are_priced(spark):
    text = "it has password=Tr0ub4dor!9xQ#zz and pwd: 0123456789abcdef0123456789abcdef!Zk#9 there; token = abcdefgh12"
    base, added = secrets.spans_of(text)
    assert [text[a:b] for a, _, b in base] == ["password=Tr0ub4dor", "0123456789abcdef0123456789abcdef", "token = abcdefgh12"]
    assert [text[a:b] for a, _, b in added] == ["Tr0ub4dor!9xQ#zz", "0123456789abcdef0123456789abcdef!Zk#9"]
    row = secrets.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.text == "it has [SECRET] and pwd: [SECRET] there; [SECRET]"


def test_prose_in_credential_context_is_left_alone():
    for text in ("the password is required", "token is generated by the server", "The secret is something else.", "my password: forgotten again",
                 "Authorization: required", "the passphrase is Important!", "the access key is available"):
        assert secrets.spans_of(text)[1] == [], text
    for value in ("zqxvkjwp", "Xk9#mQ2$", "vKq81xTz", "u7!required#Zq9"):
        assert len(secrets.spans_of(f"the password is {value} now")[1]) == 1, value


# 1


def test_best_path_with_narrow_scores_is_the_best_of_all():
    r = np.random.default_rng(1)
    cases = [np.array([[-1.0, -40, -10], [-40, -1, -10]])] + [r.normal(-10, 6, (5, 3)) for _ in range(300)]
    for s in cases:
        value = lambda p: sum(s[i, c] for i, c in enumerate(p)) - 12 * sum(a != b for a, b in zip(p, p[1:]))
        assert math.isclose(value(langid.best_path(s, 12.0).tolist()), max(map(value, itertools.product(range(3), repeat=len(s)))))


# 4


def url_table(spark):
    made = [(i, f"https://h{i % 40}.{('com/en', 'net/de')[i % 3 > 0]}/{i}") for i in range(400)] + [(400, None), (401, "http://a.xyz//q/r"), (402, "http://com")]
    return spark.createDataFrame(made, "page_id bigint, url string"), (("block", "com/en/"), ("allow", "net/de/"))


def test_block_rates_are_counted_over_all_labelled_urls(spark):
    pages, rules = url_table(spark)
    ruled = urls.with_parts(pages).withColumn("fit", urls.rule_of(rules))
    counts, n, bad = urls.rate_counts(ruled)
    rows = urls.with_rates(ruled, counts, bad / n).withColumn("fold", urls.fold()).collect()
    assert (len(rows), n, bad) == (403, 400, 134)
    keys = lambda r: (r.host.split(".")[-1], ".".join(r.host.split(".")[-2:]), f := next((p for p in r.path.split("/") if p), ""), f"{r.host.split('.')[-1]}/{f}")

    def rates(r, skip=None):
        seen, blocked = Counter(), Counter()
        for x in rows:
            if x.fit and x.fold != skip:
                seen.update(enumerate(keys(x)))
                blocked.update({k: x.fit.verdict == "block" for k in enumerate(keys(x))})
        return [(blocked[k] + 5 * bad / n) / (seen[k] + 5) for k in enumerate(keys(r))]

    assert all(np.allclose(r.rates, rates(r)) for r in rows[::7])
    others = urls.with_rates_of_others(ruled.filter("fit is not null").select("url", "host", "path", "fit"), counts, bad / n).withColumn("fold", urls.fold()).collect()
    assert len(others) == 400 and len({r.fold for r in others}) > 1
    assert all(np.allclose(r.rates, rates(r, r.fold)) for r in others[::7])
    few = {r.page_id: r for r in urls.judge(pages, rules, most_rows=20).collect()}
    assert len(few) == 403 and all(few[i].verdict == ("allow" if i % 3 else "block") for i in range(400))


def test_url_features_by_plain_python():
    made = ["https://a-b.example.com/x/y.z/?q=1&&r=22#f", "", None, "http://e/", "ftp://ü.org/a//b_c/"]
    hosts, paths = ["a-b.example.com", "", "", "e", "ü.org"], ["/x/y.z/", "", "", "/", "/a//b_c/"]
    got = urls.features(made, hosts, paths, [[0.5]] * 5)
    for u, h, p, row in zip(made, hosts, paths, got):
        u = u or ""
        query, parts, n = u.partition("?")[2].partition("#")[0], [x for x in p.split("/") if x], max(1, len(u))
        last = parts[-1] if parts else ""
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(u).values())
        want = [len(u), len(h), len(p), len(parts), sum(c in "0123456789" for c in u) / n, entropy, len([x for x in query.split("&") if x]), len(query), h.count("."), u.count("-") + u.count("_"), u.startswith("https"), len(last), "." in last, p.endswith("/"), 0.5]
        assert np.allclose(row, np.array(want, float)), u


def test_verdicts_of_open_urls_by_the_fitted_trees(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    ruled = urls.with_parts(pages).withColumn("fit", urls.rule_of())
    model, counts = urls.learn(ruled)
    rows = urls.with_rates(ruled, counts, model["prior"]).collect()
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for r in rows:
        if r.fit:
            assert (got[r.page_id].verdict, got[r.page_id].rule, got[r.page_id].block_score) == (r.fit.verdict, r.fit.rule, None)
        else:
            p = float(model["trees"].probability(urls.features([r.url], [r.host], [r.path], [r.rates]))[0])
            assert math.isclose(got[r.page_id].block_score, p) and got[r.page_id].verdict == ("block" if p >= 0.5 else "allow")
    # hosts held out: what the trees say of labelled URLs whose hosts they have not seen
    known = ruled.filter("fit is not null")
    away = F.pmod(F.xxhash64("host", F.lit(3)), F.lit(2)) == 0
    part, counts = urls.learn(known.filter(~away))
    test = urls.with_rates(known.filter(away), counts, part["prior"]).collect()
    x = urls.features([r.url for r in test], [r.host for r in test], [r.path for r in test], [r.rates for r in test])
    right = (part["trees"].probability(x) >= 0.5) == np.array([r.fit.verdict == "block" for r in test])
    assert right.mean() > 0.8


# 6


def test_long_items_show_by_their_tails_and_across_borders():
    r = random.Random(8)
    for n in (513, 600, 768, 1024, 1100, 1280):
        text = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        items = decontaminate.Items([(7, text)])
        covered = sorted({i for _, a, b, _ in items.search([text])[0] for i in range(a, b)})
        assert covered == list(range(n))
        passages = [text[-512:], *(text[at:at + 512] for at in range(0, n - 511, 256)), "".join(r.choice("xyz") for _ in range(n - 512)) + text[-512:]]
        for p in passages:
            assert {s[0] for s in items.search([f"before it {p} after it"])[0]} == {7}, n
        assert items.search([text[:200]]) == [[]]


def test_short_items_are_matched_exactly_as_words():
    items = decontaminate.Items([(1, "E=mc2"), (2, "你好吗？"), (3, "Seven"), (4, "!?"), (5, "x"), (6, "seven"), (7, None)])
    texts = ["so e = MC2.", "he wrote E=mc2!", "他说你好吗然后走了", "seventy", "a SEVEN, b", "", None, "axe", "f(x)", "sev", "en", "seven"]
    found = [[(s[0], t[s[1]:s[2]]) for s in f] for t, f in zip(texts, items.search(texts))]
    assert found == [[(1, "e = MC2")], [(1, "E=mc2")], [(2, "你好吗")], [], [(3, "SEVEN"), (6, "SEVEN")], [], [], [], [(5, "x")], [], [], [(3, "seven"), (6, "seven")]]
    assert items.search([]) == [] and items.search(["", None]) == [[], []]


def test_long_values_are_priced_as_one():
    assert secrets.spans_of("pwd: " + "*" * 300)[1] == [] and secrets.guess_cost("*" * 300)[1] == [("repeat", 0, 300)]
    assert secrets.guess_cost("ab" * 150)[1] == [("repeat", 0, 300)] and secrets.guess_cost("password" + "d" * 300)[0] < 6
    assert secrets.guess_cost("qazxsw" + "9" * 200)[1] == [("walk", 0, 6), ("repeat", 6, 206)]
    at = time.process_time()
    secrets.guess_cost("*" * 50_000 + "qw" * 10_000)
    assert time.process_time() - at < 20


def test_guess_cost_is_the_least_of_all_cuts():
    """Against every cut into segments, each priced on its own."""
    ranks, walk = secrets.ranks(), secrets.NEXT

    def price(value, i, j, per):
        part, low = value[i:j], value[i:j].lower()
        found = [("brute", (j - i) * per)]
        plain = low.translate(secrets.LEET)
        shift = math.log10(2.0) * (part != low)
        if 3 <= j - i <= secrets.LONGEST_WORD:
            if low in ranks:
                found.append(("word", math.log10(ranks[low] + 1) + shift))
            elif plain in ranks:
                found.append(("word", math.log10(ranks[plain] + 1) + math.log10(4.0) + shift))
        m = secrets.DATE.match(value, i)
        if m and m.end() == j:
            found.append(("date", math.log10(365 * 120.0) if j - i > 4 else math.log10(120.0)))
        for unit in (1, 2, 3, 4):
            if j - i >= max(3, 2 * unit) and (j - i) % unit == 0 and part == part[:unit] * ((j - i) // unit):
                found.append(("repeat", unit * per + math.log10((j - i) / unit)))
        if j - i >= 3 and all(low[k:k + 2] in walk for k in range(j - i - 1)):
            found.append(("walk", math.log10(47.0) + (j - i - 1) * math.log10(2.5)))
        return found

    def least(value):
        n, per = len(value), math.log10(secrets._spread(value))
        at = {(0, ""): 0.0}
        for i in range(n):
            for kind in ("", "brute", "other"):
                if (i, kind) in at:
                    for j in range(i + 1, n + 1):
                        for name, cost in price(value, i, j, per):
                            key = (j, "brute" if name == "brute" else "other")
                            total = at[i, kind] + cost + (math.log10(2.0) if i else 0.0)
                            at[key] = min(at.get(key, math.inf), total)
        return min(v for (j, _), v in at.items() if j == n)

    r = random.Random(4)
    for case in range(4000):
        parts = ["love", "a", "b", "ab", "!", "qwe", "19", "1999", "x9", "Pass", "aa", "zq", "0", "dragon", "#"]
        value = "".join(r.choice(parts) for _ in range(r.randrange(1, 7)))[:14] if case % 2 else "".join(r.choice("ab!lovewq12") for _ in range(r.randrange(1, 12)))
        cost, cuts = secrets.guess_cost(value)
        assert math.isclose(cost, least(value), abs_tol=1e-9), value
        assert cuts[0][1] == 0 and cuts[-1][2] == len(value) and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:])), (value, cuts)
        assert not any(a[0] == b[0] == "brute" for a, b in zip(cuts, cuts[1:])), (value, cuts)


# 5, 8, 2, 3


def test_pieces_of_long_documents_are_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "word " * 30_000), (2, "a b"), (3, None)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, group=5).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    for i in (1, 2, 3):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(itertools.accumulate([0, *(r.length for r in own)]))[:-1]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_clips_are_timed_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 9000 + "\u00ff" * 9000), (2, "")], "doc_id bigint, text string")
    features = media.read_features(media.store_texts(docs))
    rows = sorted(map(tuple, media.clips(features).collect()))
    want = sorted((r.doc_id, i, c["first"], c["last"], c["start_s"], c["end_s"]) for r in features.collect() for i, c in enumerate(r.clips))
    assert rows == want and len([r for r in rows if r[0] == 1]) > 1 and all(r[5] > r[4] for r in rows)


def test_features_of_media_by_hand(spark):
    text = "".join(chr(97 + i % 7) * 64 for i in range(200))
    row = media.read_features(media.store_texts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    raw = media.padded(text.encode())
    width, height, n = map(int, row.feature.split(";")[0].split("x"))
    frames = np.zeros(width * height * n, np.uint8)
    frames[:len(raw)] = np.frombuffer(raw, np.uint8)
    hist = np.bincount(np.frombuffer(raw, np.uint8) >> 4, minlength=16)
    shots = media.shots(list(frames.reshape(n, height, width)))
    assert row.feature == f"{width}x{height}x{n};shots={'/'.join(f'{a}-{b}' for a, b in shots)};hist={'.'.join(map(str, hist.tolist()))}"
    stored = media.store_texts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().media
    assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_lookup_by_key_ranges(spark, tmp_path):
    made = [(i // 3, f"text {i}") for i in range(90)] + [(None, "no id"), (-5, "below"), (None, None)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    manifest = sstable.write_shards(docs, f"file://{tmp_path}/s")
    asked = spark.createDataFrame([(0,), (7,), (29,), (None,), (-5,), (30,), (7,)], "doc_id bigint")
    got = Counter(r.doc_id for r in sstable.lookup(manifest, asked).collect())
    assert got == {0: 3, 7: 3, 29: 3, None: 2, -5: 1}


def test_revisits_meet_payloads_by_id_and_digest(spark, monkeypatch):
    made = [(5, "x" * 100), (3, "x" * 100), (3, "x" * 100), (9, "y" * 100), (9, "x" * 100), (None, "x" * 100), (None, "z" * 100), (1, "x")]
    pages = spark.createDataFrame(made, "page_id bigint, html string").selectExpr("page_id", "'u' AS url", "html")
    got = Counter((r.page_id, r.html[0], r.refers_to) for r in warc.decide(pages).collect())
    assert got == {(5, "x", 3): 1, (3, "x", None): 2, (9, "y", None): 1, (9, "x", 3): 1, (None, "x", 3): 1, (None, "z", None): 1, (1, "x", None): 1}


def test_scores_of_equal_texts_are_equal_beside_any_others():
    """To the last bit: BLAS rounds a row of a product by the number of rows, so batches of other sizes once scored a text apart."""
    r = np.random.default_rng(8)
    texts = [r.integers(0, 300, n).astype("<u2").tobytes() for n in r.integers(0, 90, 120)]
    counts = np.bincount(np.frombuffer(b"".join(texts), "<u2"), minlength=lm.IDS)
    end = 320
    place, begins, classes, share = lm.class_table(counts, end + 1)
    net = lm.Attention().with_subwords(begins, share, int((counts > 0).sum()))
    net.w["v"][:] = r.standard_normal(net.w["v"].shape)
    together = lm.score_ids(texts, net, place, classes, end)
    assert [lm.score_ids([t], net, place, classes, end)[0] for t in texts] == together
    order = r.permutation(len(texts)).tolist()[:77]
    assert lm.score_ids([texts[i] for i in order], net, place, classes, end, chunk=5, block=64) == [together[i] for i in order]
