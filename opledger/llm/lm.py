"""Language-model scores: a count model over words, and causal self-attention over subword ids.

The count model counts every token of every training text (words, lower-cased
A-Z, and one end per text).  Counts of the most frequent tokens, at most `hot`,
go to every executor; the others meet the texts in a join.

The attention model (numpy, one causal layer) predicts the next subword from its
context in two levels: its class, then the subword within its class, starting
from the subword's smoothed share of all training texts.  Classes are runs of
subwords by falling count and grow in size, so that frequent ones are cheap.
Long texts are scored in overlapping windows: every subword once, with at least
`OVERLAP` subwords of context where there are any.  Network weights start from a
fit on about `sample` training texts chosen by a hash of id and text; then every
window of every training text is learnt from once, in shards of about
`SHARD_BYTES` of ids on the executors, whose weights are averaged by their
numbers of windows.  Neither depends on how rows are partitioned.

Edge cases: a null or empty text is the end token alone; without training texts
all counts are 0 and the network is left at its first state; repeated rows are
scored each, and equal texts get equal scores whatever stands beside them; tokens
of equal count are ranked by id; very long texts are scored whole; an empty table
gives no row; columns other than doc_id and text are not read, but for those of
the held-out condition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, LARGE_BYTES, LARGE_ROWS, bounded, by_batches, discard, kept, slices, words_of
from .subwords import encoder, vocabulary_path

WINDOW = 32
OVERLAP = 8
WIDTH = 16
CLASSES = 32
#: Each class of subwords is larger than the one before by this factor.
GROWTH = 1.22
BATCH = 128
#: Rows of the products that score, the last ones filled up: BLAS rounds a row by the number of rows it comes with.
TILE = 64
#: Bytes of ids that one shard learns from, and networks that are averaged at once.
SHARD_BYTES = 8 << 20
MEANS = 64
ROWS = 2048
IDS = 1 << 16
#: Bound of attention scores and class scores, below the logarithm of the greatest float32.
LIMIT = np.float32(60)
#: The end token of the count model, as a number beside the hashes of words.
END = np.uint64(0x454E44)


def _exp(a: np.ndarray) -> np.ndarray:
    """exp(a) in place, a kept within `LIMIT`: sums of the values then neither overflow nor vanish, and need no greatest one."""
    return np.exp(np.clip(a, -LIMIT, LIMIT, out=a), out=a)


def _sums(a: np.ndarray) -> np.ndarray:
    """a.sum(-1) as a product: numpy is slow along short axes."""
    return a @ np.ones(a.shape[-1], a.dtype)


def _turned(a: np.ndarray) -> np.ndarray:
    """a with its last two axes changed, as a copy: products of many small matrices are slow on views."""
    return np.ascontiguousarray(a.transpose(0, 2, 1))


def _tiled(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """a @ b, a row's product being the same wherever it stands; `out`, if given, holds whole tiles."""
    tiles = -(-len(a) // TILE)
    filled = np.zeros((tiles * TILE, a.shape[1]), a.dtype)
    filled[:len(a)] = a
    into = None if out is None else out.reshape(tiles, TILE, -1)[:, :, :b.shape[1]]
    return np.matmul(filled.reshape(tiles, TILE, a.shape[1]), b, out=into).reshape(tiles * TILE, b.shape[1])[:len(a)]


class Attention:
    """One layer of masked self-attention with rows of hashed subwords as input and classes as output."""

    def __init__(self, classes: int = CLASSES, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.w = {"e": g(ROWS, WIDTH), "p": g(WINDOW, WIDTH), "qkv": g(WIDTH, 3 * WIDTH), "o": g(WIDTH, WIDTH), "u": g(WIDTH, classes), "b": np.zeros(classes, np.float32)}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.begins, self.share = np.zeros(1, np.int64), np.zeros(0, np.float32)

    def with_subwords(self, begins: np.ndarray, share: np.ndarray, used: int) -> "Attention":
        """Adds the second level: first place of each class and log shares; the first `used` places get weights."""
        self.begins, self.share = begins, share.astype(np.float32)
        self.w["v"] = np.zeros((used, WIDTH), np.float32)
        return self

    def _inside(self, h: np.ndarray, places: np.ndarray, tiled: bool = False):
        """(rows of h, first place of their class, weights, odds, their sums, log-probability of the wanted place), class by class; places ascend."""
        cuts = np.searchsorted(places, self.begins)
        for c in np.flatnonzero(np.diff(cuts)):
            lo, hi = int(self.begins[c]), int(self.begins[c + 1])
            v = self.w["v"][lo:hi]
            most = max(1, (1 << 20) // (hi - lo))
            for at in range(cuts[c], cuts[c + 1], most):
                own = slice(at, min(at + most, cuts[c + 1]))
                n = own.stop - at
                z = np.empty((-(-n // TILE) * TILE if tiled else n, hi - lo), np.float32)
                z[:, len(v):] = 0
                if tiled:
                    _tiled(h[own], v.T, z)
                    z = z[:n]
                else:
                    np.matmul(h[own], v.T, out=z[:, :len(v)])
                np.clip(z, -LIMIT, LIMIT, out=z)
                z += self.share[lo:hi]  # shares of a class come to one, so the sum of its odds lies within e**LIMIT of it
                got = z[np.arange(len(z)), places[own] - lo]
                np.exp(z, out=z)
                total = z.sum(-1) if tiled else _sums(z)
                yield own, lo, v, z, total, got - np.log(total)

    def inside(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural log-probability of places, each within its class, given hidden states."""
        order = np.argsort(places.astype(np.uint16), kind="stable")
        out = np.empty(len(h))
        for own, *_, got in self._inside(h.take(order, 0), places[order], True):
            out[order[own]] = got
        return out

    @staticmethod
    def rows(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int32)

    def forward(self, rows: np.ndarray):
        """Inputs, projections (queries scaled), attention before and its divisors, contexts and hidden states for windows of row numbers."""
        w = self.w
        x = w["e"].take(rows, 0)
        x += w["p"]
        q, k, v = np.split(x @ w["qkv"], 3, axis=2)  # here and below one product a window
        q *= np.float32(WIDTH**-0.5)
        a = _exp(q @ _turned(k))
        a *= self.mask
        total = _sums(a)[:, :, None]
        c = a @ v
        c /= total
        return x, (q, k, v), a, total, c, x + c @ w["o"]

    def classes_of(self, h: np.ndarray, targets: np.ndarray, tiled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(odds of classes, their sums, natural log-probability of the target class) for rows of hidden states."""
        z = _tiled(h, self.w["u"]) if tiled else h @ self.w["u"]
        z += self.w["b"]
        np.clip(z, -LIMIT, LIMIT, out=z)
        got = z[np.arange(len(z)), targets]
        np.exp(z, out=z)
        total = z.sum(-1) if tiled else _sums(z)
        return z, total, got - np.log(total)

    def log_probability(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of the target class at every place of every window."""
        h = self.forward(rows)[-1]
        return self.classes_of(h.reshape(-1, WIDTH), targets.ravel())[-1].reshape(targets.shape)

    def _step_inside(self, h, places, weight, n, state, rate) -> tuple[float, np.ndarray]:
        """One Adagrad step of the second level: (loss, gradient of the hidden states)."""
        loss, dh = 0.0, np.zeros_like(h)
        seen = state.setdefault("v", np.zeros_like(self.w["v"]))
        live = np.flatnonzero(weight)
        live = live[np.argsort(places[live].astype(np.uint16), kind="stable")]
        held, wanted = h.take(live, 0), places[live]
        back = np.empty_like(held)
        for own, lo, v, z, total, got in self._inside(held, wanted):
            loss -= float(got.sum()) / n
            z[np.arange(len(z)), wanted[own] - lo] -= total
            z, scale = z[:, :len(v)], 1 / (total * np.float32(n))[:, None]
            np.multiply(z @ v, scale, out=back[own])
            g = z.T @ (held[own] * scale)
            past = seen[lo:lo + len(v)]
            past += g * g
            g *= 2 * rate
            g /= np.sqrt(past) + 1e-8
            v -= g
        dh[live] = back
        return loss, dh

    def step(self, rows, targets, weight, state, rate, places=None):
        """One Adam step on windows; weight is 0 where a place is no subword; places are learnt within their classes if given."""
        w = self.w
        x, (q, k, v), a, total, c, h = self.forward(rows)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        h, wanted, share = flat(h), targets.ravel(), weight.ravel()
        n = max(1.0, float(share.sum()))
        dz, sums, got = self.classes_of(h, wanted)
        loss = -float((got * share).sum()) / n
        dz *= (share / (n * sums))[:, None]
        dz[np.arange(len(dz)), wanted] -= share / np.float32(n)
        g = {"u": h.T @ dz, "b": dz.sum(0)}
        dh = dz @ w["u"].T
        if places is not None:
            more, inner = self._step_inside(h, places.ravel(), share, n, state, rate)
            loss += more
            dh += inner
        g["o"] = flat(c).T @ dh
        dc = (dh @ w["o"].T).reshape(c.shape)
        mean = _sums(dc * c)[:, :, None]  # of the gradient under the attention
        dc /= total
        da = dc @ _turned(v)
        dv = a.transpose(0, 2, 1) @ dc
        da -= mean / total
        da *= a
        dq = da @ k
        dq *= np.float32(WIDTH**-0.5)
        dqkv = np.concatenate([dq, da.transpose(0, 2, 1) @ q, dv], 2)
        g["qkv"] = flat(x).T @ flat(dqkv)
        dx = dh.reshape(x.shape) + dqkv @ w["qkv"].T
        g["p"] = dx.sum(0)
        g["e"] = np.zeros_like(w["e"])
        order = np.argsort(rows.ravel().astype(np.int16), kind="stable")
        own = rows.ravel()[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        g["e"][own[first]] = np.add.reduceat(flat(dx)[order], first, axis=0)
        state["t"] += 1
        for name, d in g.items():
            m, s = state.setdefault(name, (np.zeros_like(d), np.zeros_like(d)))
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            w[name] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(s / (1 - 0.99 ** state["t"])) + 1e-8)).astype(np.float32)
        return loss


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, first place to score, places) of the windows over runs of places of these lengths, laid end to end."""
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    begin = np.repeat(np.cumsum(lengths) - lengths, count)
    which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = begin + which * step
    end = np.minimum(start + WINDOW, begin + np.repeat(lengths, count))
    return start, np.where(which > 0, start + OVERLAP, start), end


def class_table(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of every id by falling count, first place of each class (and the end), class of every place, natural log of its share in the class."""
    order = np.argsort(-counts[:size], kind="stable")
    place = np.zeros(IDS, np.int64)
    place[order] = np.arange(size)
    begins = np.unique(np.round(size * (GROWTH ** np.arange(CLASSES + 1) - 1) / (GROWTH**CLASSES - 1)).astype(np.int64))
    classes = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    smooth = counts[order] + 1.0
    return place, begins, classes, np.log(smooth / np.add.reduceat(smooth, begins[:-1])[classes])


def laid_out(texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts with their ends, the id before each, lengths) of texts of ids as two bytes each."""
    arrays = [np.frombuffer(t, "<u2") for t in texts]
    end = np.array([end_id], np.uint16)
    flat = np.concatenate([x for a in arrays for x in (a, end)])
    before = np.empty_like(flat)
    before[1:] = flat[:-1]  # the end of the text before serves as the start of the next
    before[0] = end_id
    return flat, before, np.array([len(a) + 1 for a in arrays], np.int64)


def score_ids(texts: list[bytes], net: Attention, place: np.ndarray, classes: np.ndarray, end_id: int, chunk: int = 64, block: int = 1 << 15) -> list[float]:
    """log10 probability of each text (ids as two bytes each), its end included."""
    flat, before, lengths = laid_out(texts, end_id)
    rows, wanted = net.rows(before), place[flat]
    first = classes[wanted]
    out = np.empty(len(flat))
    start, score_from, ends = windows(lengths)
    places = np.arange(WINDOW)
    states, spots, held = [], [], 0
    for at in range(0, len(start), chunk):
        own = start[at:at + chunk, None] + places
        inside = np.minimum(own, len(flat) - 1)
        keep = (own >= score_from[at:at + chunk, None]) & (own < ends[at:at + chunk, None])
        states.append(net.forward(rows[inside])[-1][keep])
        spots.append(own[keep])
        out[spots[-1]] = net.classes_of(states[-1], first[spots[-1]], True)[-1]
        held += len(spots[-1])
        if held >= block or at + chunk >= len(start):  # the second level takes many places at once
            spot = np.concatenate(spots)
            out[spot] += net.inside(np.concatenate(states), wanted[spot])
            states, spots, held = [], [], 0
    firsts = np.cumsum(lengths) - lengths
    return (np.add.reduceat(out, firsts) / np.log(10)).tolist()


def _count_words(rows: DataFrame) -> DataFrame:
    """token (hash), n: counts of all tokens of all rows, combined in each task before they are dealt out."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def merged():
            keys, counts = (np.concatenate(x) for x in zip(*held))
            found, where = np.unique(keys, return_inverse=True)
            return found, np.bincount(where, counts, len(found)).astype(np.int64)

        def batch_of(found, n):
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in slices(batches, "text"):
            words, _ = words_of(batch.column("text").to_pylist())
            found, n = np.unique(words, return_counts=True)
            held.append((np.append(found, END), np.append(n, batch.num_rows)))
            size += len(found) + 1
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            found, n = merged()
            for at in range(0, len(found), 100_000):
                yield batch_of(found[at:at + 100_000], n[at:at + 100_000])

    return bounded(rows).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _count_ids(rows: DataFrame) -> np.ndarray:
    def run(batches):
        import pyarrow as pa

        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=IDS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    found = rows.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(IDS, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _learn(net: Attention, state: dict, flat, before, start, ends, place, classes, rate: float) -> None:
    """One step on the windows that begin at `start`."""
    own = start[:, None] + np.arange(WINDOW)
    inside = np.minimum(own, len(flat) - 1)
    wanted = place[flat[inside]]
    net.step(net.rows(before[inside]), classes[wanted], (own < ends[:, None]).astype(np.float32), state, rate, wanted)


def fit(net: Attention, sample: list[bytes], place: np.ndarray, classes: np.ndarray, end_id: int, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Attention:
    """First weights, from texts of ids."""
    if not sample:
        return net
    r, state = np.random.default_rng(seed), {"t": 0}
    flat, before, lengths = laid_out(sample, end_id)
    start, _, ends = windows(lengths)
    for i in range(steps):
        pick = r.integers(0, len(start), batch)
        _learn(net, state, flat, before, start[pick], ends[pick], place, classes, rate * (1 - i / steps) + 1e-4)
    return net


def fit_shard(net: Attention, batches, place: np.ndarray, classes: np.ndarray, end_id: int, rate: float = 0.005, seed: int = 12) -> int:
    """Learns once from every window of every text (batches of texts of ids) in place; the number of windows."""
    r, state, seen = np.random.default_rng(seed), {"t": 0}, 0
    for texts in batches:
        flat, before, lengths = laid_out(texts, end_id)
        count = -(-lengths // WINDOW)
        which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(lengths) - lengths, count) + which * WINDOW
        ends = np.minimum(start + WINDOW, np.repeat(np.cumsum(lengths), count))
        order = r.permutation(len(start))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            _learn(net, state, flat, before, start[pick], ends[pick], place, classes, rate / (1 + state["t"] / 500) ** 0.5)
        seen += len(start)
    return seen


def _texts_of_shards(batches, most: int = BATCH_BYTES):
    """(shard, its texts in lists of about `most` bytes) from batches sorted by shard; lists do not depend on how rows are batched."""
    shard, texts, size, lists = None, [], 0, []
    for batch in batches:
        for s, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
            if s != shard:
                if texts:
                    lists.append(texts)
                if lists:
                    yield shard, lists
                shard, texts, size, lists = s, [], 0, []
            texts.append(ids)
            size += len(ids)
            if size >= most:
                lists.append(texts)
                texts, size = [], 0
    if texts:
        lists.append(texts)
    if lists:
        yield shard, lists


def fit_all(rows: DataFrame, net: Attention, place: np.ndarray, classes: np.ndarray, end_id: int, shards: int) -> tuple[Attention, int]:
    """The network after a pass over all texts (columns key, ids), and the windows learnt from: weights of shards, averaged by their windows.

    Texts go to shards and stand in them by their keys, so the result does not depend on how rows are partitioned.
    """
    shared = rows.sparkSession.sparkContext.broadcast((net, place, classes, end_id))
    names = sorted(net.w)

    def run(batches):
        import copy

        import pyarrow as pa

        first, place, classes, end_id = shared.value
        for shard, lists in _texts_of_shards(batches):
            own = copy.deepcopy(first)
            n = fit_shard(own, lists, place, classes, end_id)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int64()), pa.array(names), pa.array([n] * len(names), pa.int64()), pa.array([own.w[k].tobytes() for k in names], pa.binary())], names=["shard", "name", "n", "w"])

    def mean(table):
        import pyarrow as pa

        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        n, w = table.column("n").to_numpy()[order], table.column("w").to_pylist()
        total = sum(np.frombuffer(w[i], np.float32) * (float(k) / n.sum()) for i, k in zip(order.tolist(), n))
        return pa.table({"shard": pa.array([int(table.column("shard")[0].as_py()) // MEANS], pa.int64()), "name": [table.column("name")[0].as_py()], "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema, seen, left = "shard bigint, name string, n bigint, w binary", 0, shards
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "ids")
    found = kept(bounded(dealt.select("shard", "ids")).mapInArrow(run, schema), "weights")
    while True:  # so many networks at once meet in a task
        met = found.groupBy("name", F.floor(F.col("shard") / MEANS).alias("m")).applyInArrow(mean, schema)
        left = -(-left // MEANS)
        if left == 1:
            break
        found = kept(met, "weights")
    for r in met.collect():  # one network
        net.w[r.name] = np.frombuffer(r.w, np.float32).reshape(net.w[r.name].shape).copy()
        seen = r.n
    discard(found)
    return net, seen


def score(docs: DataFrame, held_out: Column, path: str | None = None, sample: int = 1500, hot: int = 500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (columns doc_id, text)."""
    path, spark = path or vocabulary_path(), docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))

    def encode(batch):
        return {c: batch.column(c) for c in ("row", "doc_id", "held_out", "key", "text")} | {"ids": encoder(path).encode(batch.column("text").to_pylist())}

    coded = kept(by_batches(rows, encode, "row bigint, doc_id bigint, held_out boolean, key bigint, text string, ids binary", "text", LARGE_BYTES, LARGE_ROWS), "coded")
    train = coded.filter("not held_out")
    counts = kept(_count_words(train.select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, n_types = int(total[0]), int(total[1])
    # the least count whose tokens are no more than `hot`, in steps of a sixteenth of a power of two
    level = F.floor(F.log2(F.col("n")) * 16).cast("int")
    least, have = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        have += r["count"]
        if have > hot:
            break
        least = r.level
    often = counts.filter(level >= least if least is not None else F.lit(False)).toArrow()
    order = np.argsort(often["token"].to_numpy().view(np.uint64))
    end_id = encoder(path).library.get_vocab_size() - 1
    id_counts = _count_ids(train.select("ids"))
    n_docs = train.count()
    id_counts[end_id] += n_docs
    place, begins, classes, share = class_table(id_counts, end_id + 1)
    part = min(1.0, sample / max(1, n_docs))
    chosen = train.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(part * (1 << 30))).select("key", "ids").orderBy("key", "ids").toArrow()["ids"].to_pylist()
    net = fit(Attention().with_subwords(begins, share, int((id_counts > 0).sum())), chosen, place, classes, end_id)
    if n_docs:
        net, _ = fit_all(train.select("key", "ids"), net, place, classes, end_id, max(1, -(-2 * int(id_counts.sum()) // SHARD_BYTES)))
    model = spark.sparkContext.broadcast({
        "token": often["token"].to_numpy().view(np.uint64)[order], "n": often["n"].to_numpy()[order],
        "net": net, "classes": classes, "place": place, "end": end_id, "log": float(np.log10(n_train + n_types + 1)),
    })

    def work(batch):
        m = model.value
        words, lengths = words_of(batch.column("text").to_pylist())
        n = batch.num_rows
        owner = np.repeat(np.arange(n), lengths)
        keys, of, c = np.append(words, np.full(n, END)), np.append(owner, np.arange(n)), None
        if len(m["token"]):
            at = np.minimum(np.searchsorted(m["token"], keys), len(m["token"]) - 1)
            c = np.where(m["token"][at] == keys, m["n"][at], 0)
        else:
            c = np.zeros(len(keys), np.int64)
        base = np.bincount(of, np.where(c > 0, np.log10(c + 1.0) - m["log"], 0.0), n)
        known = np.bincount(of, c > 0, n).astype(np.int64)
        rare = np.flatnonzero(c == 0)
        rare = rare[np.lexsort((keys[rare], of[rare]))]
        k, o = keys[rare].view(np.int64), of[rare]
        ends = np.searchsorted(o, np.arange(n + 1))
        return {c: batch.column(c) for c in ("row", "doc_id", "held_out")} | {
            "n_tokens": lengths + 1, "known": known, "base": base,
            "score": score_ids(batch.column("ids").to_pylist(), m["net"], m["place"], m["classes"], m["end"]),
            "rare": [k[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())],
        }

    scored = kept(by_batches(coded, work, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<bigint>", "text"), "scored")
    seldom = scored.select("row", F.explode("rare").alias("token"))
    met = seldom.join(counts, "token", "left").select("row", F.coalesce("n", F.lit(0)).alias("c"))
    sums = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0) - float(np.log10(n_train + n_types + 1))).alias("more"), F.sum((F.col("c") > 0).cast("bigint")).alias("more_known"))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
