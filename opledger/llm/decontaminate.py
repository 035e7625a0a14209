"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are normalised (lower case; runs of other characters than letters and
digits become one blank).  An item of m characters may differ by
e = min(floor(rate * m), floor(m / q) - 1) edits, the second being all that the
lemma can bound.  Where it lies in a document with at most e edits, they share at
least m + 1 - q * (e + 1) of its q-grams, and the alignment keeps to e + 1
neighbouring diagonals.  So shared q-grams are counted in overlapping bands of
2 * (e + 1) diagonals, a band starting every e + 1; bands that reach the bound
are regions, and a region is a leak where an alignment within its band has at
most e edits.

Items longer than `longest` characters are cut to windows of that length that
start every half of it, the last one at the item's end, so that a long item also
shows by a part of it; each window found is a row, and these may overlap.

Edge cases: null and empty texts match nothing; items of under 13 characters
are matched exactly (no edit is within the rate), those under `Q` characters as
whole words (in scripts without blanks, anywhere); repeated items and rows each
give their own rows; of overlapping matches of one window that with fewest edits is
kept, of equally good ends the first; very long documents are searched whole; an empty
table on either side gives no row; further columns of any name are not read by
leaks and kept by clean.  A benchmark of more than `most_bytes` is searched in blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, discard, kept, mix

Q = 8
RATE = 0.08
SLOTS = 1 << 22
#: Shared q-grams that are counted at once, and bands that are aligned at once.
HITS = 1 << 21
BANDS = 256
# First and last code point of scripts written without blanks.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


class _Folding:
    """Code point to folded code point: lower-case letters and digits as they are, all else a blank."""

    made = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.made is None:
            table = np.full((1 << 16) + 1, 0x20, np.uint32)
            for c in range(1 << 16):
                if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
                    low = chr(c).lower()
                    table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
            cls.made = table
        return cls.made


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, their places in the texts laid end to end, first folded point of each text, first place of each text)."""
    lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _Folding.get()[np.minimum(points, 1 << 16)]
    high = np.flatnonzero(points >= 1 << 16)
    if len(high):
        folded[high] = [c if chr(c).isalnum() else 0x20 for c in points[high].tolist()]
    begins = np.cumsum(lengths) - lengths
    blank = folded == 0x20
    keep = ~blank
    if len(blank):
        keep[1:] |= blank[1:] & ~blank[:-1]
        first = begins[lengths > 0]
        keep[first] = True  # a blank at a text's start stays, so that texts do not run into each other
    places = np.flatnonzero(keep)
    return folded[places], places, np.searchsorted(places, begins), begins


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of every run of q points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    p = points.astype(np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += p[j:j + n]
    return mix(h)


def borders(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a word may start or end before each point, and after the last."""
    free = points == 0x20
    for lo, hi in UNSPACED:
        free |= (points >= lo) & (points <= hi)
    out = np.ones(len(points) + 1, bool)
    out[1:-1] = free[1:] | free[:-1]
    out[firsts] = True
    return out


def banded_edits(item: np.ndarray, text: np.ndarray, starts: np.ndarray, most: int, first: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best alignment of the whole item to a part of text[first[k]:upto[k]], for each band k; edits is most + 1 if there is none.

    A band is 2 * (most + 1) diagonals from starts[k] on; a diagonal is the place in
    the text less the place in the item.  Only its cells are computed, row by row
    over the item and for all bands at once; a match starts at any diagonal, and
    insertions along a row are settled by a running minimum.  Of equal costs the
    first end counts.
    """
    width, far, first, upto = 2 * (most + 1), most + 1, first[:, None], upto[:, None]
    along = np.arange(width, dtype=np.int32)
    place = starts[:, None] + along  # place in the text of the next character, on each diagonal
    never = np.int32(1 << 20)
    cost = np.where((place >= first) & (place <= upto), 0, never).astype(np.int32)
    begin = place.copy()
    padded = np.append(text, np.zeros(1, text.dtype))
    for c in item.tolist():
        inside = (place >= first) & (place < upto)
        swap = cost + (padded[np.where(inside, place, len(text))] != c) + np.where(inside, 0, never)
        drop = np.full_like(cost, never)  # the item's character is left out: one diagonal lower
        drop[:, :-1] = cost[:, 1:] + 1
        other = np.zeros_like(begin)
        other[:, :-1] = begin[:, 1:]
        place = place + 1
        better = swap <= drop
        cost, begin = np.where(better, swap, drop).astype(np.int32), np.where(better, begin, other)
        cost[(place < first) | (place > upto)] = never
        shifted = cost - along
        low = np.minimum.accumulate(shifted, axis=1)
        moved = (low < shifted) & (place <= upto) & (place >= first)
        if moved.any():
            source = np.maximum.accumulate(np.where(shifted == low, along, 0), axis=1)
            begin = np.where(moved, np.take_along_axis(begin, source, 1), begin)
            cost = np.where(moved, low + along, cost)
        if cost.min() > most:
            break
    at = cost.argmin(1)
    rows = np.arange(len(starts))
    edits = np.minimum(cost[rows, at], far)
    return edits, np.where(edits < far, begin[rows, at], 0), np.where(edits < far, place[rows, at], 0)


class Items:
    """Benchmark windows with their q-grams, ready for search."""

    def __init__(self, rows: list[tuple[int, str | None]], q: int = Q, rate: float = RATE, longest: int = 512):
        self.q = q
        self.ids, self.points, self.edits, self.bound = [], [], [], []
        hashes, owners, places = [], [], []
        #: length -> hash -> (points, ids) of items shorter than q
        self.short: dict[int, dict[int, list[tuple[np.ndarray, int]]]] = {}
        for number, text in rows:
            whole, _, _, _ = normal([text])
            whole = whole[int(len(whole) > 0 and whole[0] == 0x20):]
            whole = whole[:len(whole) - int(len(whole) > 0 and whole[-1] == 0x20)]
            if len(whole) < q:
                if len(whole):
                    self.short.setdefault(len(whole), {}).setdefault(int(grams(whole, len(whole))[0]), []).append((whole, number))
                continue
            cuts = [*range(0, len(whole) - longest, longest // 2), max(0, len(whole) - longest)]
            for at in cuts:
                p = whole[at:at + longest] if len(whole) > longest else whole
                m = len(p)
                e = min(int(rate * m), m // q - 1)
                g = grams(p, q)
                hashes.append(g)
                owners.append(np.full(len(g), len(self.ids)))
                places.append(np.arange(len(g)))
                self.ids.append(number)
                self.points.append(p)
                self.edits.append(e)
                self.bound.append(m + 1 - q * (e + 1))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        h, o, p = join(hashes, np.uint64), join(owners, np.int64), join(places, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], o[order], p[order]
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.hash & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        self.edit, self.least = np.array(self.edits, np.int64), np.array(self.bound, np.int64)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item, start, end, edits) in code points of every leak, by text."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        folded = normal(texts)
        self._search_short(*folded, out)
        self._search_long(*folded, out)
        return [sorted(x, key=lambda s: (s[1], s[2], s[0] if s[0] is not None else -1)) for x in out]

    def _search_short(self, points, places, firsts, begins, out) -> None:
        """Adds the exact places of items shorter than q."""
        if not self.short or not len(points):
            return
        edge, upto = borders(points, firsts), np.append(firsts[1:], len(points))
        for n, known in self.short.items():
            if len(points) < n:
                continue
            at = np.flatnonzero(edge[:len(points) - n + 1] & edge[n:])
            h = grams(points[at[:, None] + np.arange(n)].ravel(), n)[::n] if len(at) else np.zeros(0, np.uint64)
            hit = np.isin(h, np.array(list(known), np.uint64))
            at, h = at[hit], h[hit]
            for spot, d, x in zip(at.tolist(), (np.searchsorted(firsts, at, side="right") - 1).tolist(), h.tolist()):
                if spot + n <= upto[d]:
                    out[d] += [(number, int(places[spot] - begins[d]), int(places[spot + n - 1] - begins[d]) + 1, 0) for item, number in known[x] if np.array_equal(item, points[spot:spot + n])]

    def _search_long(self, points, places, firsts, begins, out) -> None:
        """Adds the leaks of windows."""
        h = grams(points, self.q)
        if not len(h) or not len(self.hash):
            return
        at = np.flatnonzero(self.slots[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[at])
        hi = np.searchsorted(self.hash, h[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return
        doc = np.searchsorted(firsts, at, side="right") - 1
        bands = len(points) + 8194
        if len(firsts) * len(self.ids) * bands >= 1 << 62:
            raise ValueError("too many texts and items for one batch")
        ends, counted = np.cumsum(n), ([], [])
        cuts = [0, *np.flatnonzero(np.diff(ends // HITS)).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:]):  # so many shared q-grams at once
            if a == b:
                continue
            m = n[a:b]
            which = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)
            owner, spot = self.owner[which], np.repeat(at[a:b], m)
            base, width = spot - self.place[which] + 4096, self.edit[owner] + 1
            pair = (np.repeat(doc[a:b], m) * len(self.ids) + owner) * bands
            for shift in (0, 1):  # two families of bands of twice the width, half a band apart
                counted[shift].append(np.unique(pair + (base // width + shift) // 2, return_counts=True))
        regions = []
        for shift, parts in enumerate(counted):
            names, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.bincount(where, np.concatenate([c for _, c in parts]), len(names))
            owner = names // bands % len(self.ids)
            ok = total >= self.least[owner]
            names, owner = names[ok], owner[ok]
            low = (2 * (names % bands) - shift) * (self.edit[owner] + 1) - 4096
            regions.append(np.stack([owner, names // bands // len(self.ids), low], 1))
        found = np.unique(np.concatenate(regions), axis=0)
        upto = np.append(firsts[1:], len(points))
        marks = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
        for a, b in zip(marks.tolist(), [*marks[1:].tolist(), len(found)]):
            o, d = int(found[a, 0]), found[a:b, 1]
            for doc, edits, s, e in self._verified(o, points, d, firsts[d], upto[d], found[a:b, 2]):
                out[doc].append((self.ids[o], int(places[s] - begins[doc]), int(places[e - 1] - begins[doc]) + 1, edits))

    def _verified(self, o: int, points, docs, first, upto, starts) -> list[tuple[int, int, int, int]]:
        """(document, edits, start, end) of matches of a window within bands of documents; of those that overlap, the one with fewest edits, then the first."""
        item, most = self.points[o], self.edits[o]
        spans, rest, raw, size = [], [], item.tobytes(), item.itemsize
        for i, (d, lo, hi, low) in enumerate(zip(docs.tolist(), first.tolist(), upto.tolist(), starts.tolist())):
            a, b = max(lo, low), min(hi, low + 2 * (most + 1) + len(item) - 1)
            part = points[a:b].tobytes() if b > a else b""
            at = part.find(raw)
            while at > 0 and at % size:
                at = part.find(raw, at + 1)
            if at >= 0:  # an exact match needs no alignment
                spans.append((d, 0, a + at // size, a + at // size + len(item)))
            else:
                rest.append(i)
        for at in range(0, len(rest), BANDS):
            own = np.array(rest[at:at + BANDS], np.int64)
            got = banded_edits(item, points, starts[own], most, first[own], upto[own])
            spans += [(int(d), int(x), int(y), int(z)) for d, x, y, z in zip(docs[own], *got) if x <= most and z > y]
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for d, edits, s, e in sorted(set(spans)):
            near = out.setdefault(d, [])
            if not any(x[2] < e and s < x[3] for x in near):
                near.append((d, edits, s, e))
        return [x for near in out.values() for x in near]


class Benchmark:
    """A benchmark's items, in blocks of bounded size."""

    def __init__(self, rows: DataFrame, blocks: int):
        self.rows, self.blocks = rows, blocks

    def items(self, block: int) -> Items:
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)) == block
        found = [(r[0], r[1]) for r in self.rows.filter(own).collect()]
        return Items(sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))


def load(benchmark: DataFrame, most_bytes: int = 16 << 20, item: str = "item_id", text: str = "text") -> Benchmark:
    """The benchmark's items in blocks of about most_bytes of text, each small enough to be sent to all executors."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return Benchmark(rows, max(1, -(-size // most_bytes)))


def leaks(docs: DataFrame, items: Benchmark, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per leak: key, item_id, start, end (code points of the text), edits."""
    context, names = docs.sparkSession.sparkContext, ("key_", "item_id", "start", "end", "edits")

    def found(block: int) -> DataFrame:
        shared = context.broadcast(items.items(block))

        def work(batch):
            by_text = shared.value.search(batch.column("text_").to_pylist())
            keys = batch.column("key_").to_pylist()
            rows = [(keys[i], *s) for i, spans in enumerate(by_text) for s in spans]
            return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}

        kind = dict(docs.dtypes)[key]
        out = by_batches(docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_")), work, f"key_ {kind}, item_id bigint, start bigint, end bigint, edits bigint", "text_")
        if items.blocks > 1:  # one block at a time
            out = kept(out, "leaks")
            shared.destroy()
        return out

    return reduce(DataFrame.unionByName, [found(b) for b in range(items.blocks)]).withColumnRenamed("key_", key)


def clean(docs: DataFrame, items: Benchmark) -> DataFrame:
    """documents without those that hold a leak."""
    context, names = docs.sparkSession.sparkContext, docs.columns
    for block in range(items.blocks):
        shared = context.broadcast(items.items(block))

        def work(batch, shared=shared):
            import pyarrow as pa

            found = shared.value.search(batch.column("text").to_pylist())
            left = batch.filter(pa.array([not f for f in found], pa.bool_()))
            return {c: left.column(c) for c in names}

        rest = by_batches(docs, work, docs.schema, "text")
        if items.blocks > 1:  # one block at a time
            rest = kept(rest, "clean")
            shared.destroy()
            if block:
                discard(docs)
        docs = rest
    return docs
