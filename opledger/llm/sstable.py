"""Sorted-string-table shards of token ids.

A shard holds entries in ascending key order: prefix-compressed blocks (a full
key every 16 entries), each compressed and checksummed; a sparse index with the
last key and place of every block; a Bloom filter; a footer.  A lookup asks the
filter, searches the index by bisection and reads one block.

A key is the document id as an order-keeping binary number, then a hash of the
text and a running number, so that repeated ids keep all their rows.

Edge cases: a null id sorts before all others; a null text is the empty text,
which holds only the end id; rows with the same id stand in the order of their
text hashes; repeated rows are entries each; a very long text is one entry, and
its block is as large as it; ids that are looked up and not there give no row;
an empty table gives no shard and no row; columns other than key and text are
not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LARGE_BYTES, LARGE_ROWS, bounded, kept, scratch, slices
from .files import Writer, open_file, read_range
from .subwords import encoder, vocabulary_path

MAGIC = b"SSTSHRD1"
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY = 10
PROBES = 7
_FOOTER = struct.Struct("<QQQQQQQ8s")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def id_key(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def key_id(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _probes(prefix: bytes, bits: int) -> list[int]:
    """Places of an id in the filter: two checksums, combined."""
    a, b = zlib.crc32(prefix), zlib.crc32(prefix, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, uri: str):
        import zstandard

        self.out = Writer(uri)
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.filtered: list[bytes] = []
        self.count = self.ids = 0
        self.first_key = None

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if self.first_key is None:
            self.first_key = key
        elif key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries, self.last = self.entries + 1, key
        self.count, self.ids = self.count + 1, self.ids + n_ids
        self.filtered.append(key[:9])
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            body = self.pack(bytes(self.block))
            at = self.out.write(struct.pack("<II", zlib.crc32(body), len(self.block)) + body)
            self.index.append((self.last, at, len(body) + 8))
            self.block, self.entries = bytearray(), 0

    def close(self) -> int:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        index_at = self.out.write(index)
        bits = max(64, len(self.filtered) * BITS_PER_KEY)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for k in self.filtered:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.out.write(bloom.tobytes())
        self.out.write(_FOOTER.pack(index_at, len(index), bloom_at, bits, self.count, self.ids, len(self.index), MAGIC))
        self.out.close()
        return self.out.at


class Shard:
    """Reads a shard: in order, or single ids."""

    def __init__(self, uri: str):
        import zstandard

        self.file = open_file(uri)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        (self.index_at, index_size, bloom_at, self.bits, self.count, self.ids, blocks, magic) = _FOOTER.unpack(read_range(self.file, size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.index = read_range(self.file, self.index_at, index_size), 0, []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            key, at = raw[at:at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.bloom = read_range(self.file, bloom_at, -(-self.bits // 8))

    def block(self, i: int) -> list[tuple[bytes, bytes]]:
        _, offset, length = self.index[i]
        raw = read_range(self.file, offset, length)
        crc, size = struct.unpack_from("<II", raw)
        if zlib.crc32(raw[8:]) != crc:
            raise ValueError("a block is damaged")
        data, at, key, out = self.unpack(raw[8:], max_output_size=size), 0, b"", []
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at:at + more]
            at += more
            out.append((key, data[at:at + n]))
            at += n
        return out

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of all rows with this id."""
        want = id_key(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(want, self.bits)):
            return []
        out = []
        for i in range(bisect_left(self.index, (want,)), len(self.index)):
            found = self.block(i)
            out += [v for k, v in found if k[:9] == want]
            if found[-1][0][:9] > want:
                break
        return out


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes one shard per range of ids; returns the manifest (written to the shared folder, one row per shard)."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        at, writer, n, nulls, first, last = task.partitionId(), None, 0, 0, None, None
        uri = f"{folder}/part-{at:06d}-{task.taskAttemptId()}.sst"
        encode = encoder(path).encode
        tail = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches, "text", LARGE_BYTES):
            writer = writer or ShardWriter(uri)
            for i, h, ids in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), encode(batch.column("text").to_pylist())):
                writer.add(id_key(i) + (h + (1 << 63)).to_bytes(8, "big") + n.to_bytes(6, "big"), ids + tail, len(ids) // 2 + 1)
                n += 1
                if i is None:
                    nulls += 1
                else:
                    first, last = i if first is None else first, i
        if writer:
            made = {"shard": at, "n_docs": writer.count, "n_ids": writer.ids, "bytes": writer.close(), "null_ids": nulls, "first_id": first, "last_id": last}
            yield pa.RecordBatch.from_pydict({"uri": [uri]} | {c: pa.array([v], pa.int64()) for c, v in made.items()})

    return kept(bounded(rows, LARGE_ROWS).mapInArrow(run, "uri string, shard bigint, n_docs bigint, n_ids bigint, bytes bigint, null_ids bigint, first_id bigint, last_id bigint"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry, from the files; a task reads whole shards in order."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard: a few thousand at most
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    dealt = placed.repartition(max(1, manifest.count()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, at in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(uri)
                for i in range(len(shard.index)):
                    ids, starts, sizes, crcs = [], [], [], []
                    for k, v in shard.block(i):
                        wide = np.frombuffer(v, "<u2").astype("<u4")
                        ids.append(key_id(k))
                        starts.append(at)
                        sizes.append(len(wide))
                        crcs.append(zlib.crc32(wide.tobytes()))
                        at += len(wide)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, sizes, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """All token lists of the ids asked for (column doc_id), by key ranges, filter, index search and single block reads.

    The manifest's least and greatest ids (one row per shard: a few thousand) tell
    which shards may hold an id; each shard is opened by the task of its ids.
    """
    spans = manifest.select("uri", "null_ids", "first_id", "last_id").orderBy("shard").collect()
    known = [r for r in spans if r.first_id is not None]
    # shards follow each other by id: of neighbours only the ends may be equal
    firsts, lasts = [r.first_id for r in known], [r.last_id for r in known]
    nulls, uris = [r.uri for r in spans if r.null_ids], [r.uri for r in known]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, u) for i in batch.column("doc_id").to_pylist() for u in (nulls if i is None else uris[bisect_left(lasts, i):bisect_right(firsts, i)])]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([u for _, u in rows], pa.string())], names=["doc_id", "uri"])

    def run(batches):
        import pyarrow as pa

        uri, shard = None, None
        for batch in batches:
            ids, tokens = [], []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("uri").to_pylist()):
                if own != uri:
                    uri, shard = own, Shard(own)
                for v in shard.get(doc_id):
                    ids.append(doc_id)
                    tokens.append(np.frombuffer(v, "<u2").astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    asked = ids.select(F.col("doc_id").cast("bigint")).distinct().mapInArrow(place, "doc_id bigint, uri string")
    return asked.repartition("uri").sortWithinPartitions("uri", "doc_id").mapInArrow(run, "doc_id bigint, tokens array<int>")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, scratch(spark, "shards"), path))
