"""N-gram Jaccard join over count vectors in R-trees; links and connected components, exactly.

A document is the set of its distinct word shingles (64-bit hashes).  Equal sets
are one node.  Shingles are hashed into groups, and the counts of the groups are
a point; the overlap of two sets is at most the sum of the smaller counts, so an
R-tree finds for a point all others that can reach the threshold: a subtree is
skipped where the sum of minima with its upper corner is too small.  Surviving
pairs are verified on the sets.

One tree over all points would not scale: points of unrelated texts of like
length crowd together.  So trees stand in cells that every linked pair shares.
Sizes are cut into overlapping windows.  In a window the shingles of a set fall
into as many groups as linked sets can differ in, an eighth more, and three; a
cell is a group with its content.  A set that can differ from a linked one in d
shingles has its first d + n cells that are not empty, n being that eighth and
three.  Of two linked sets take the one whose cells end at the lower group: at
most d of these differ, so the two share n cells or more: what they `need`.  (A
set with fewer groups that are not empty needs as many less.)  A set with fewer
cells in company than it needs links with nothing.  Any other leaves out its
most crowded cells, needs - 1 of them: of the cells that two linked sets share,
the rarest is in both.

All sets of a cell go to the tree of the cell's window and least node, with their
shingles; larger trees are cut into parts that also hold the least node.  A task
searches its tree, verifies pairs that no verified links join yet, and gives the
links.  Where the parts of a tree hold sets that are still apart, those outside
its largest component then meet every part, and all pairs that pass the bound
are verified.  So a group of copies costs a few verified pairs for each member.

Edge cases: null, empty or blank texts have no shingle and link with nothing;
a text with fewer words than a shingle is one shingle; repeated rows and ids
are kept; a null id never is the name of a component unless all ids of it are
null; very long texts are used whole; ties between sets are settled by their
hashes and change no result; an empty table gives no row; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, discard, kept, mix, sided, slices, swept, words_of
from .graph import components

EXTRA = 3
WINDOWS = 64
#: A part of a tree has at most about so many points, and so many bytes of shingles.
BLOCK = 4096
BLOCK_BYTES = 24 << 20


class Rule:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_overlap(self, a, b):
        """Smallest intersection with which sets of these sizes link."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def windows(self, size: int) -> list[tuple[int, int, int]]:
        """(number, greatest size, most shingles by which linked sets differ) of the windows of sizes that hold this size.

        For the greater set of any linked pair, the first window that holds it also holds the smaller one.
        """
        out, number, lo, hi = [], 0, 1, 1
        while self._most(hi + 1) == 0:
            hi += 1
        while lo <= size:
            if size <= hi:
                out.append((number, hi, self._most(hi)))
            number, lo = number + 1, -((-self.num * (hi + 1)) // self.den)
            hi = max(2 * lo, hi + 1)
        return out

    def differ(self, size: int, hi: int) -> int:
        """Most shingles by which a set of this size differs from a linked one of at most hi shingles."""
        return (size + min(hi, size * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def _most(self, size: int) -> int:
        return 2 * size * (self.den - self.num) // (self.den + self.num)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = words_of(texts)
    n = len(words)
    h = words.copy()
    for j in range(1, k):
        h[:n - j] = mix(h[:n - j] * np.uint64(0x9E3779B97F4A7C15) + words[j:]) if n > j else h[:n - j]
    at = 0
    for c in counts.tolist():
        if c >= k:
            yield np.unique(h[at:at + c - k + 1])
        elif c:
            x = words[at:at + 1]
            for j in range(1, c):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + words[at + j:at + j + 1])
            yield mix(x + np.uint64(c))
        else:
            yield words[:0]
        at += c


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def cells_of(shingles: np.ndarray, rule: Rule) -> list[tuple[int, np.ndarray]]:
    """(needs, names of the cells) of a set in each of its windows; the last bits of a name are the window's number.

    Empty groups are cells only of sets that could share nothing else.
    """
    out = []
    spread, content = mix(shingles ^ np.uint64(0xA5A5A5A5)), mix(shingles + np.uint64(0xC0FFEE))
    for number, hi, most in rule.windows(len(shingles)):
        if most == 0:
            continue  # here only equal sets link
        groups = most + EXTRA + most // 8
        g = (spread % np.uint64(groups)).astype(np.int64)
        sums, counts = np.zeros(groups, np.uint64), np.bincount(g, minlength=groups)
        np.add.at(sums, g, content)
        names = mix(sums * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 1_000_003) + np.arange(groups, dtype=np.uint64))
        names = names & np.uint64(2**64 - WINDOWS) | np.uint64(number % WINDOWS)
        full, differ = np.flatnonzero(counts), rule.differ(len(shingles), hi)
        own = full[:differ + EXTRA + most // 8]
        out.append((len(own) - differ, names[own]) if len(own) > differ else (1, names))
    return out


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    """The count vectors of sets: about a coordinate for every four shingles of the largest, for fewer would not keep long texts apart."""
    sizes = np.array([len(s) for s in sets])
    width = min(4096, 1 << max(5, (int(sizes.max()) // 4).bit_length()))
    place = (mix(np.concatenate(sets) + np.uint64(0x1234567)) & np.uint64(width - 1)).astype(np.int64)
    place += np.repeat(np.arange(len(sets)) * width, sizes)
    return np.bincount(place, minlength=len(sets) * width).reshape(len(sets), width).astype(np.uint32)


class RTree:
    """Points bulk-loaded by size and then by halving on the widest coordinate.

    Every node keeps its least and greatest size and, of the points folded to
    COARSE coordinates, the upper corner.  Rows that pass are held against the
    bound in coarse and then in all coordinates.
    """

    COARSE = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule, leaf: int = 16, slab: int = 128):
        self.rule, self.sizes, self.points = rule, sizes, points
        self.coarse = points if points.shape[1] <= self.COARSE else points.reshape(len(points), -1, self.COARSE).sum(1, dtype=np.uint32)
        by_size, order = np.argsort(sizes, kind="stable"), []
        todo = [by_size[at:at + slab] for at in range(0, len(by_size), slab)][::-1]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                order.append(rows)
                continue
            own = self.coarse[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            half = np.argpartition(own[:, axis], len(rows) // 2)
            todo += [rows[half[len(rows) // 2:]], rows[half[:len(rows) // 2]]]
        self.leaves = order
        upper = np.stack([self.coarse[r].max(0) for r in order])
        least, most = np.array([sizes[r].min() for r in order]), np.array([sizes[r].max() for r in order])
        self.levels = [(upper, least, most)]
        while len(upper) > 8:
            cut = np.arange(0, len(upper), 8)
            upper, least, most = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((upper, least, most))

    def search(self, row: int) -> np.ndarray:
        """Rows whose overlap with the set of this row can reach the threshold (the row itself too)."""
        return self.find(self.points[row], self.coarse[row], int(self.sizes[row]))

    def find(self, point: np.ndarray, coarse: np.ndarray, size: int) -> np.ndarray:
        rule, at = self.rule, np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[depth]
            at = at[(rule.den * most[at] >= rule.num * size) & (rule.num * least[at] <= rule.den * size)]
            at = at[np.minimum(upper[at], coarse).sum(1, dtype=np.int64) >= rule.least_overlap(least[at], size)]
            if depth:
                n = len(self.levels[depth - 1][0])
                at = (at[:, None] * 8 + np.arange(8)).ravel()
                at = at[at < n]
        if not len(at):
            return at
        rows = np.concatenate([self.leaves[i] for i in at])
        need = rule.least_overlap(self.sizes[rows], size)
        ok = np.minimum(self.coarse[rows], coarse).sum(1, dtype=np.int64) >= need
        rows, need = rows[ok], need[ok]
        return rows[np.minimum(self.points[rows], point).sum(1, dtype=np.int64) >= need]


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest of the text, n_shingles and node of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text").to_pylist(), k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "digest", "n_shingles", "node"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id bigint, digest bigint, n_shingles bigint, node bigint")


def cells(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """node, needs, cell: all cells of every node, once for each task that meets it."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in slices(batches, "text"):
            rows: list[tuple[int, int, np.ndarray]] = []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                node = node_of(s) if len(s) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    rows += [(node, needs, names.view(np.int64)) for needs, names in cells_of(s, rule)]
            if rows:
                node, needs, names = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(needs, pa.int32()), pa.array(names, pa.list_(pa.int64()))], names=["node", "needs", "cells"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(run, "node bigint, needs int, cells array<bigint>").select("node", "needs", F.explode("cells").alias("cell"))


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, shingles of the wanted nodes (node, rep), from the texts of their representatives."""
    ids = sided(kept(wanted.select("rep").distinct(), "ids"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, rows.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part.column("text").to_pylist(), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return bounded(rows).mapInArrow(run, "node bigint, shingles binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links_of(sets: list[np.ndarray], rule: Rule, label: np.ndarray, asking: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that is linked: pairs (row, row) of sets.

    label: components known before.  Only pairs with an asking row are looked at.
    A pair that passes the tree's bound is verified unless links join it already.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    points = points_of(sets)
    tree, label, out = RTree(points, sizes, rule), label.copy(), []
    order = np.argsort(-sizes, kind="stable")
    order = order[asking[order]]
    turn = np.full(len(sets), -1)
    turn[order] = np.arange(len(order))
    for i in order.tolist():
        found = tree.search(i)
        found = found[(label[found] != label[i]) & (turn[found] < turn[i])]
        if len(found) > 1:
            slack = np.minimum(points[found], points[i]).sum(1, dtype=np.int64) - rule.least_overlap(sizes[found], int(sizes[i]))
            found = found[np.argsort(-slack, kind="stable")]
        while len(found):
            j, found = int(found[0]), found[1:]
            if shared(sets[i], sets[j]) >= rule.least_overlap(int(sizes[j]), int(sizes[i])):
                out.append((i, j))
                label[label == label[j]] = label[i]
                found = found[label[found] != label[i]]
    return out


def _trees(keys: list[str], rule: Rule):
    """Work on rows (keys, node, shingles, component, asks) sorted by keys: the links (a, b) that a tree per key gives."""

    def linked(rows) -> tuple[np.ndarray, np.ndarray]:
        node, asks = rows.column("node").to_numpy(), rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((~asks, node))
        first = order[np.flatnonzero(np.diff(node[order], prepend=node[order[0]] - 1))]
        raw = rows.column("shingles")
        sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in first.tolist()]
        label = np.unique(rows.column("component").to_numpy()[first], return_inverse=True)[1]
        pairs = np.array(links_of(sets, rule, label, asks[first]), np.int64).reshape(-1, 2)
        return node[first[pairs[:, 0]]], node[first[pairs[:, 1]]]

    def run(batches):
        import pyarrow as pa

        def whole(rows):
            a, b = linked(rows)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        held, last = [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and last != key[:, lo].tolist():
                    yield whole(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key[:, lo].tolist()
        if held:
            yield whole(pa.Table.from_batches(held).combine_chunks())

    return run


def _searched(rows: DataFrame, keys: list[str], rule: Rule, name: str) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return kept(bounded(dealt).mapInArrow(_trees(keys, rule), "a bigint, b bigint").distinct(), name)


def stars(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """least, window, node (kept): which sets meet in which tree."""
    rows = cells(docs, k, rule)
    counts = kept(rows.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least <> most").select("cell", "n"), "counts")
    swept(docs.sparkSession)
    met = kept(rows.join(counts.hint("shuffle_hash"), "cell").select("node", F.col("cell").bitwiseAND(WINDOWS - 1).cast("int").alias("window"), "needs", "n", "cell"), "met")
    discard(counts)
    swept(docs.sparkSession)
    own = W.partitionBy("node", "window")
    ranked = met.repartition("node").dropDuplicates(["node", "cell"]).withColumns({"have": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("n", "cell"))})
    stay = kept(ranked.filter("have >= needs and rank <= have - needs + 1").select("node", "window", "cell"), "stay")
    discard(met)
    least = stay.groupBy("cell").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("cell", "least")
    out = kept(stay.join(least, "cell").select("least", "window", "node").distinct(), "stars")
    discard(stay)
    swept(docs.sparkSession)
    return out


def link(docs: DataFrame, nodes: DataFrame, k: int, rule: Rule) -> DataFrame:
    """node, component of every node (node, n_shingles, rep) that links with another."""
    spark = docs.sparkSession
    met = stars(docs, k, rule)
    wanted = kept(nodes.join(met.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = kept(shingles_of(docs, wanted, k), "sets")
    key = ["least", "window"]
    blocks = lambda n, held: F.ceil(F.greatest(n / BLOCK, held * 8 / BLOCK_BYTES)).cast("int")
    sized = met.join(wanted.select("node", "n_shingles"), "node")
    sizes = sized.groupBy(*key).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    large = kept(sizes.select(*key, blocks(F.col("n"), F.col("held")).alias("parts")).filter("parts > 1"), "large")
    placed = met.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = placed.select(*key, "node", F.explode(F.when((F.col("node") == F.col("least")) & (F.col("parts") > 1), every).otherwise(F.array(own))).alias("part"))
    first = dealt.join(sets, "node").select(*key, "part", "node", "shingles", F.col("node").alias("component"), F.lit(True).alias("asks"))
    links = _searched(first, [*key, "part"], rule, "links")
    named = components(links)
    if not large.isEmpty():
        # the parts of a tree: sets outside its largest component meet every part
        split = sized.join(large, key).join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        counts = split.groupBy(*key, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
        main = counts.groupBy(*key).agg(F.max(F.struct("n", "component", "held")).alias("top"), F.sum("n").alias("n"), F.sum("held").alias("held"))
        main = main.select(*key, F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("held") - F.col("top.held")).alias("asking"))
        apart = kept(split.join(main.filter("asking > 0"), key).withColumn("part", own), "apart")
        if not apart.isEmpty():
            turn = F.pmod(F.xxhash64("node", F.lit(7)), F.col("asking")).cast("int")
            asks = apart.filter("component <> main").select(*key, F.explode(every).alias("part"), turn.alias("turn"), "node", "component", F.lit(True).alias("asks"))
            holds = apart.select(*key, "part", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("turn"), "node", "component", F.lit(False).alias("asks"))
            second = asks.unionByName(holds).join(sets, "node").select(*key, "part", "turn", "node", "shingles", "component", "asks")
            more = _searched(second, [*key, "part", "turn"], rule, "links")
            if not more.isEmpty():
                discard(named)
                named = components(links.unionByName(more))
            discard(more)
        discard(apart)
    discard(links, large, sets, met, wanted)
    swept(spark)
    return named


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component and component_id of every row.

    component names the linked sets and is null without shingles; component_id is the smallest id reachable by links.
    """
    rule = Rule(num, den)
    feats = kept(features(docs, k), "features")
    nodes = kept(feats.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "nodes")
    named = link(docs, nodes, k, rule)
    every = nodes.select("node", "rep").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = every.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = kept(every.join(heads, "component").select("node", "component", "component_id"), "classes")
    discard(named, nodes)
    return feats.join(final, "node", "left").select("doc_id", "digest", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every document."""
    return classes(docs, k, num, den).select("doc_id", "n_shingles", "component_id")
