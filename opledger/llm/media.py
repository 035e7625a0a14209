"""Media columns: AVI files of motion JPEG.

Writing keeps bytes losslessly as 8-bit samples: frames are lossless JPEG
(process 14, predictor 1) whose Huffman code gives every difference nine bits.
Reading parses the RIFF tree and its idx1 index, decodes the intra frames
(lossless and baseline ones, with whatever tables they carry) and detects shots
by histogram differences against a threshold that adapts to the frames before.

Edge cases: a null or empty payload is one row of zeros; the last frame is
filled with zeros, and the INFO list holds the true length; a file without an
index is walked chunk by chunk; a damaged file raises ValueError; very long
payloads have as many frames as they need and are decoded whole, some at a time;
repeated rows give repeated rows, and equal payloads equal files; of equal
histograms no shot begins; an empty table gives no row; columns other than the
key and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches

UNIT = 64
TALLEST = 64
FPS = 25
BITS = 9  # of every difference: 9 - n bits for its category n, then n bits


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit code of every difference (index difference + 255), and the difference of every code, modulo 256."""
    code, value = np.zeros(511, np.uint16), np.zeros(512, np.uint8)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        prefix = ((1 << (8 - n)) - 1) << 1  # 8 - n ones and a zero
        code[d + 255] = prefix << n | (d if d >= 0 else d + (1 << n) - 1)
        value[code[d + 255]] = d & 255
    return code, value


def _pack(codes: np.ndarray) -> np.ndarray:
    """Rows of nine-bit codes, a multiple of eight each, as bytes."""
    c = codes.reshape(-1, 8).astype(np.uint32)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (c[:, i - 1] << (8 - i)) | (c[:, i] >> (i + 1))
    out[:, 8] = c[:, 7]
    return out.reshape(len(codes), -1)


def _unpack(data: np.ndarray) -> np.ndarray:
    """The inverse of _pack for rows of bytes."""
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        out[:, i] = ((b[:, i] << (i + 1)) | (b[:, i + 1] >> (7 - i))) & 511
    return out.reshape(len(data), -1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    lengths = bytes([1] * BITS + [0] * (16 - BITS))
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\0" + lengths + bytes(range(8, -1, -1)))
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], width: int, height: int, payload: int) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d" % payload)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        made = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(made)
        at += len(made)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def write_avis(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of 64 bytes); all are coded at once."""
    rows = [len(p) // UNIT for p in payloads]
    frames = [-(-r // TALLEST) for r in rows]
    heights = [-(-r // n) for r, n in zip(rows, frames)]
    filled = [h * n for h, n in zip(heights, frames)]
    data = np.frombuffer(b"".join(p + b"\0" * (UNIT * (f - r)) for p, f, r in zip(payloads, filled, rows)), np.uint8).reshape(-1, UNIT).astype(np.int16)
    before = np.empty_like(data)
    before[:, 1:] = data[:, :-1]
    before[1:, 0] = data[:-1, 0]
    first = np.cumsum([0, *np.repeat(heights, frames)])[:-1]
    before[first, 0] = 128
    scans = _pack(_codes()[0][data - before + 255])
    out, at = [], 0
    for p, h, n in zip(payloads, heights, frames):
        head = _frame_head(UNIT, h)
        made = []
        for _ in range(n):
            made.append(head + scans[at:at + h].tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9")
            at += h
        out.append(_avi(made, UNIT, h, len(p)))
    return out


def parse_avi(data: bytes) -> dict:
    """Width, height, frame rate, payload length (or None) and (offset, length) of each video chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"payload": None, "rate": (FPS, 1)}
    movi = index = None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > len(data):
                raise ValueError("a chunk ends after the file")
            if name == b"LIST":
                kind = data[body:body + 4]
                if kind == b"movi":
                    movi = (body, body + size)
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                found["width"], found["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body:body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                found["rate"] = (rate, scale or 1)
            elif name == b"ICMT" and data[body:body + 8] == b"payload=":
                found["payload"] = int(data[body + 8:body + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = data[body:body + size]
            at = body + size + (size & 1)
    if movi is None:
        raise ValueError("no movie list")
    frames = []
    if index is not None:
        for name, _, offset, size in struct.iter_unpack("<4sIII", index[:len(index) // 16 * 16]):
            if name[2:] not in (b"dc", b"db"):
                continue
            at = movi[0] + offset if data[movi[0] + offset:movi[0] + offset + 4] == name else offset  # some count from the file's start
            if data[at:at + 4] != name or struct.unpack_from("<I", data, at + 4)[0] != size:
                raise ValueError("the index and the movie differ")
            frames.append((at + 8, size))
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2:at + 4] in (b"dc", b"db"):
                frames.append((at + 8, size))
            at += 8 + size + (size & 1)
    return found | {"frames": frames}


@lru_cache(maxsize=256)
def _huffman(body: bytes) -> dict:
    """(length, code) to symbol of one table."""
    table, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            table[(length, code)] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _parse_jpeg(data: bytes) -> dict:
    """Frame header, tables and the scan's bytes without stuffing."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    out: dict = {"huffman": {}, "quant": {}, "restart": 0}
    at = 2
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["huffman"][body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDB:
            while body:
                n = 129 if body[0] >> 4 else 65
                out["quant"][body[0] & 15] = np.frombuffer(body[1:n], ">u2" if body[0] >> 4 else np.uint8).astype(float)
                body = body[n:]
        elif marker in (0xC0, 0xC1, 0xC3):
            out["lossless"] = marker == 0xC3
            out["precision"], out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            out["scan"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}
            out["first"] = body[1 + 2 * n]
            end = data.rfind(b"\xff\xd9")
            out["bits"] = data[at:end if end >= at else len(data)]
            return out
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("this JPEG process is not supported")


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            self.value <<= n - self.left  # past the end: zeros
            self.left = n
        self.left -= n
        got = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return got

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[(length, code)]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        if n == 0:
            return 0
        got = self.take(n)
        return got if got >> (n - 1) else got - (1 << n) + 1


@lru_cache(maxsize=1)
def _zigzag() -> list[int]:
    return [8 * y + x for _, _, y, x in sorted((y + x, y if (y + x) & 1 else x, y, x) for y in range(8) for x in range(8))]


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * 0.5
    m[:, 0] /= np.sqrt(2)
    return m



def decode_frame(data: bytes) -> np.ndarray:
    """Samples of one intra frame, first component only (the luminance of colour frames)."""
    j = _parse_jpeg(data)
    h, w = j["height"], j["width"]
    runs = j["bits"]
    pieces = [runs]
    if j["restart"]:
        import re

        pieces = re.split(rb"\xff[\xd0-\xd7]", runs)
    pieces = [p.replace(b"\xff\0", b"\xff") for p in pieces]
    if j["lossless"]:
        table = j["huffman"][j["scan"][j["parts"][0][0]] >> 4]
        bits, out = _Bits(pieces[0]), np.zeros((h, w), np.int64)
        codes = _huffman(table)
        for y in range(h):
            for x in range(w):
                if y == 0:
                    guess = out[y, x - 1] if x else 1 << (j["precision"] - 1)
                elif x == 0:
                    guess = out[y - 1, 0]
                else:
                    a, b, c = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
                    guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[j["first"]]
                out[y, x] = (int(guess) + bits.signed(bits.symbol(codes))) & 0xFFFF
        return out.astype(np.uint8)
    hs, vs = max(p[1] for p in j["parts"]), max(p[2] for p in j["parts"])
    across, down = -(-w // (8 * hs)), -(-h // (8 * vs))
    tables = {p[0]: (_huffman(j["huffman"][j["scan"][p[0]] >> 4]), _huffman(j["huffman"][16 | j["scan"][p[0]] & 15])) for p in j["parts"]}
    first = j["parts"][0]
    plane = np.zeros((8 * first[2] * down, 8 * first[1] * across))
    order, m = _zigzag(), _cosines()
    step = j["restart"] or across * down
    for unit in range(across * down):
        if unit % step == 0:
            bits, dc = _Bits(pieces[unit // step]), dict.fromkeys(tables, 0)
        my, mx = divmod(unit, across)
        for part in j["parts"]:
            for by in range(part[2]):
                for bx in range(part[1]):
                    block = np.zeros(64)
                    dc[part[0]] += bits.signed(bits.symbol(tables[part[0]][0]))
                    block[0] = dc[part[0]]
                    k = 1
                    while k < 64:
                        s = bits.symbol(tables[part[0]][1])
                        if s & 15 == 0:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        block[order[k]] = bits.signed(s & 15)
                        k += 1
                    if part is first:
                        scale = np.zeros(64)
                        scale[order] = j["quant"][part[3]]
                        y, x = 8 * (my * part[2] + by), 8 * (mx * part[1] + bx)
                        plane[y:y + 8, x:x + 8] = m @ (block * scale).reshape(8, 8) @ m.T
    return np.clip(np.rint(plane[:h, :w] + 128), 0, 255).astype(np.uint8)


def decode_avis(files: list[bytes]) -> list[tuple[dict, list[np.ndarray]]]:
    """(what parse_avi finds, decoded frames) of each file; frames with the nine-bit code are decoded together."""
    parsed = [parse_avi(f) for f in files]
    quick, heights, out = [], [], []
    for f, p in zip(files, parsed):
        own: list = []
        for at, size in p["frames"]:
            frame = f[at:at + size]
            h = p["height"]
            head = _frame_head(UNIT, h)
            if frame.startswith(head):
                raw = frame[len(head):-2].replace(b"\xff\0", b"\xff")
                if len(raw) == h * UNIT * BITS // 8:
                    own.append(len(quick))
                    quick.append(raw)
                    heights.append(h)
                    continue
            own.append(decode_frame(frame))
        out.append((p, own))
    if quick:
        rows = np.frombuffer(b"".join(quick), np.uint8).reshape(-1, UNIT * BITS // 8)
        d = _codes()[1][_unpack(rows)]
        ends = np.cumsum(heights)
        first = ends - heights
        column = np.cumsum(d[:, 0], dtype=np.uint8)
        base = np.repeat(column[first] - d[first, 0], heights)
        d[:, 0] = column - base + np.uint8(128)
        d = np.cumsum(d, axis=1, dtype=np.uint8)
        whole = [d[a:b] for a, b in zip(first.tolist(), ends.tolist())]
        out = [(p, [whole[x] if isinstance(x, int) else x for x in own]) for p, own in out]
    return out


def shots(frames: list[np.ndarray], window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A shot begins where the histogram of 32 bins differs from that of the frame
    before by more than `least` and by more than mean + factor * deviation of up
    to `window` earlier differences of the shot.
    """
    if len(frames) < 2:
        return [(0, len(frames) - 1)] if frames else []
    hist = np.stack([np.bincount(f.ravel() >> 3, minlength=32) / f.size for f in frames])
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / 2).tolist()
    cuts, past = [0], []
    for i, d in enumerate(diff):
        recent = past[-window:]
        mean = sum(recent) / len(recent) if recent else least
        deviation = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else least
        if d > least and d > mean + factor * deviation:
            cuts.append(i + 1)
            past = []
        else:
            past.append(d)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(frames)])]


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and the AVI file (media) that holds the UTF-8 bytes of each text."""

    def work(batch):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column("text_").to_pylist()]
        return {key: batch.column(key), "n_bytes": [len(r) for r in raw], "media": write_avis([padded(r) for r in raw])}

    return by_batches(docs.select(key, F.col(text).alias("text_")), work, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes bigint, media binary", "text_", 1 << 20)


def read_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files hold, read from their bytes: payload digests, media digests, clips and a feature text."""

    def work(batch):
        files = batch.column("media").to_pylist()
        out = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")}
        for f, (p, frames) in zip(files, decode_avis(files)):
            samples = b"".join([x.tobytes() for x in frames])[:p["payload"]]
            found = shots(frames)
            rate, scale = p["rate"]
            clips = [{"first": a, "last": b, "start_s": a * scale / rate, "end_s": (b + 1) * scale / rate} for a, b in found]
            total = np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-UNIT:]))
            out["media_bytes"].append(len(f))
            out["media_sha256"].append(hashlib.sha256(f).hexdigest())
            out["clips"].append(clips)
            out["feature"].append(f"{p['width']}x{p['height']}x{len(frames)};shots={'/'.join(f'{a}-{b}' for a, b in found)};hist={'.'.join(map(str, total.tolist()))}")
        return {key: batch.column(key), "n_bytes": batch.column("n_bytes")} | out

    schema = f"`{key}` {dict(media.dtypes)[key]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<first:bigint,last:bigint,start_s:double,end_s:double>>"
    return by_batches(media, work, schema, "media", 1 << 20)


def clips(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per clip of what read_features gives: key, clip (from 0), first and last frame, start_s and end_s."""
    rows = features.select(F.col(key).alias("key_"), F.posexplode("clips").alias("clip", "c"))
    return rows.select(F.col("key_").alias(key), F.col("clip").cast("bigint"), "c.first", "c.last", "c.start_s", "c.end_s")
