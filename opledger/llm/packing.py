"""Packing of token sequences: first fit decreasing over a tournament tree of bin capacities.

Documents are cut to pieces of at most a sequence, these are dealt into randomised
groups, and each group is packed alone.  After first fit the emptiest
sequences are cut up to fill the gaps of the others, and the one that remains
is cut at powers of two, which need no padding.

Edge cases: a null or empty text is one piece that holds only the end id;
repeated rows are packed each; a very long document is spread over many
sequences and groups; pieces of one length go in the order in which the group
holds them, which changes no total; an empty table gives no row; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_BYTES, LARGE_ROWS, by_batches
from .subwords import encoder, vocabulary_path

LENGTH = 2048
GROUP = 1000


class Tournament:
    """Room of bins in the leaves, the greater of two in every inner node: finds the first bin with enough room."""

    def __init__(self, room: int):
        self.room, self.bins, self.leaves = room, 0, 1
        self.tree = [0, room]

    def place(self, need: int) -> int:
        """The first bin with room for `need`, which it takes; a new bin where there is none."""
        if self.tree[1] < need:
            half, self.leaves = self.leaves, self.leaves * 2
            tree = [0] * (2 * self.leaves)
            for i in range(half):
                tree[self.leaves + i] = self.tree[half + i]
                tree[self.leaves + half + i] = self.room
            for i in range(self.leaves - 1, 0, -1):
                tree[i] = max(tree[2 * i], tree[2 * i + 1])
            self.tree = tree
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        found = at - self.leaves
        self.bins = max(self.bins, found + 1)
        tree[at] -= need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found


def pack(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start in it, length).  Every document has at least one id."""
    done, rest = [], []
    for i, n in enumerate(lengths):
        whole = n // length
        done += [[(i, k * length, length)] for k in range(whole)]
        if n % length:
            rest.append((n % length, i, whole * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(length)
    bins: list[list[tuple[int, int, int]]] = []
    for n, i, start in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((i, start, n))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -fill[k])
    lo, hi = 0, len(order) - 1
    while lo < hi:  # the emptiest bin feeds the gaps of the fullest
        a, b = order[lo], order[hi]
        gap = length - fill[a]
        while gap and bins[b]:
            i, start, n = bins[b].pop()
            take = min(n, gap)
            bins[a].append((i, start, take))
            if take < n:
                bins[b].append((i, start + take, n - take))
            gap, fill[a], fill[b] = gap - take, fill[a] + take, fill[b] - take
        if not gap:
            lo += 1
        if not bins[b]:
            hi -= 1
    packed = done + [bins[k] for k in order if bins[k] and fill[k] == length]
    for k in order:
        left, pieces = fill[k], bins[k]
        if left == length:
            continue
        while left:  # powers of two, largest first
            room = 1 << (left.bit_length() - 1)
            left -= room
            made = []
            while room:
                i, start, n = pieces.pop()
                take = min(n, room)
                made.append((i, start, take))
                if take < n:
                    pieces.append((i, start + take, n - take))
                room -= take
            packed.append(made)
    return packed


def encode_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, doc_tokens and ids (two bytes each) of every piece of at most `length` ids, the end id included."""
    path = path or vocabulary_path()

    def work(batch):
        tail = np.array([end_id], "<u2").tobytes()
        out: dict[str, list] = {c: [] for c in ("key_", "start", "doc_tokens", "ids")}
        for k, x in zip(batch.column("key_").to_pylist(), encoder(path).encode(batch.column("text_").to_pylist())):
            x += tail
            for at in range(0, len(x), 2 * length):
                for c, v in zip(out, (k, at // 2, len(x) // 2, x[at:at + 2 * length])):
                    out[c].append(v)
        return out

    rows = docs.select(F.col(key).cast("bigint").alias("key_"), F.col(text).cast("string").alias("text_"))
    return by_batches(rows, work, "key_ bigint, start bigint, doc_tokens bigint, ids binary", "text_", LARGE_BYTES, LARGE_ROWS)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, end_id: int = 1, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids themselves.

    Documents are cut to pieces of at most `length` ids where they are read; groups
    of about `group` pieces are drawn at random for each, so that neither a key, a
    source nor a very long document makes a group large.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    groups = max(1, -(-n // group), -(-size // (2 * group * length)))  # an id stands for two bytes or more of most texts
    dealt = encode_pieces(docs, path, length, end_id).withColumn("g", F.floor(F.rand(seed) * groups).cast("bigint"))

    def run(table):
        import pyarrow as pa

        ids, keys, begins, totals = (table.column(c).to_pylist() for c in ("ids", "key_", "start", "doc_tokens"))
        base = table.column("g")[0].as_py() << 32
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for s, pieces in enumerate(pack([len(x) // 2 for x in ids], length)):
            at = 0
            for i, start, n in pieces:
                own = np.frombuffer(ids[i], "<u2", n, 2 * start)
                for c, v in zip(out, (keys[i], begins[i] + start, n, zlib.crc32(own.astype("<u4").tobytes()), totals[i], base + s, at, own.tobytes())):
                    out[c].append(v)
                at += n
        return pa.table({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    return dealt.groupBy("g").applyInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
