"""Language identification of mixed-language texts.

Script ranges narrow the candidate languages of every word; words are scored by
letter trigrams; a Viterbi pass with a switching penalty labels spans.  A text
gets the language that holds most of its letters.

Training counts trigrams of labelled texts on the executors.  The fit takes about
`per_language` texts of each of the `most_languages` most frequent labels, chosen
by a hash of key and text (documented bounds); predictions read whole texts.

Edge cases: a null text, an empty one or one without a letter is `und` with
score 0; ties go to the first language in alphabetical order; without labelled
rows every text is `und`; very long texts are labelled whole; repeated rows give
repeated rows; an empty table gives no row; other columns, whatever their names,
are not read by identify and kept by accept.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_batches

UNKNOWN = "und"
BUCKETS = 1 << 15
# First and last code point of script blocks.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


class _Letters:
    """Tables over the basic plane, built once per worker: letter or not, lower case, script."""

    made = None

    def __init__(self):
        n = 1 << 16
        self.letter = np.zeros(n + 1, bool)
        self.lower = np.arange(n + 1, dtype=np.uint32)
        self.script = np.zeros(n + 1, np.uint8)
        for c in range(n):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                self.letter[c] = True
                low = ch.lower()
                if len(low) == 1 and ord(low) < n:
                    self.lower[c] = ord(low)
            elif unicodedata.category(ch)[0] == "M":
                self.letter[c] = True
        for name, lo, hi in SCRIPTS:
            self.script[lo:hi + 1] = NAMES.index(name)
        self.letter[n] = True  # stands for every code point above the basic plane that is a letter

    @classmethod
    def get(cls):
        if cls.made is None:
            cls.made = cls()
        return cls.made


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, word starts, word ends, script of each word, words in each text)."""
    t = _Letters.get()
    points = np.frombuffer("\n".join("" if x is None else x for x in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    small = np.minimum(points, 1 << 16)
    letter = t.letter[small]
    high = np.flatnonzero(small == 1 << 16)
    if len(high):
        letter[high] = [chr(c).isalpha() for c in points[high].tolist()]
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((1 if x is None else len(x) + 1 for x in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.cumsum(lengths)), prepend=0)
    script = t.script[small[starts]] if len(starts) else np.zeros(0, np.uint8)
    return t.lower[small], starts, ends, script, counts


def trigrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for every letter of every word (the trigram that it ends, word edges included), and the first of each word."""
    p = points.astype(np.uint32)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)
    b = np.where(at > 0, p[at - 1], 0)
    a = np.where(at > 1, p[at - 2], 0)
    begins = np.zeros(len(at), bool)
    begins[first] = True
    b[begins] = 1
    a[begins] = 1
    second = first[lengths > 1] + 1
    a[second] = 1
    h = (p[at] * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (a * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int32), first


def train(docs: DataFrame, per_language: int = 1500, most_languages: int = 256, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict:
    """Trigram and script counts of about per_language texts of each labelled language, for the most_languages most frequent labels."""
    known = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"), F.col(lang).alias("lang_")).filter("lang_ is not null and text_ is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang_").agg(F.count("*").alias("n_")).orderBy(F.desc("n_"), "lang_").limit(most_languages).collect()}
    empty = {"languages": [], "score": np.zeros((BUCKETS, 0), np.float32), "script": np.zeros((len(NAMES), 0), bool)}
    if not sizes:
        return empty
    names = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("lang_") == n, F.lit(min(1.0, per_language / sizes[n]))) for n in names])
    unit = F.pmod(F.xxhash64("key_", "text_"), F.lit(1 << 30)) / float(1 << 30)
    number = {n: i for i, n in enumerate(names)}

    def count(batches):
        import pyarrow as pa

        from .common import slices

        for batch in slices(batches, "text"):
            points, starts, ends, script, counts = cut(batch.column("text").to_pylist())
            if not len(starts):
                continue
            owner = np.repeat(np.array([number[v] for v in batch.column("lang").to_pylist()]), counts)
            h, _ = trigrams(points, starts, ends)
            lengths = ends - starts
            cells = np.repeat(owner, lengths).astype(np.int64) * (BUCKETS + len(NAMES))
            both = np.concatenate([cells + h, cells + BUCKETS + np.repeat(script, lengths)])
            found, n = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["cell", "n"])

    rows = known.filter(unit < share).select(F.col("text_").alias("text"), F.col("lang_").alias("lang"))
    cells = bounded(rows).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    width = BUCKETS + len(NAMES)
    flat = np.zeros(len(names) * width)
    if cells.num_rows:
        flat[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = flat.reshape(len(names), width)
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    letters = np.maximum(scripts.sum(1, keepdims=True), 1)
    return {"languages": names, "score": np.ascontiguousarray(logs.T.astype(np.float32)), "script": (scripts / letters >= 1e-4).T}


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labelling of words with the greatest sum of scores less a penalty for every change.

    Where no run of words gains more than half the penalty by another language, the
    labelling is one language throughout (k such runs in a row pay for k - 1 changes
    at least); else the recurrence is run.
    """
    n, k = scores.shape
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    main = int(np.argmax(scores.sum(0)))
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, main:main + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, main)
    best, back = scores[0].astype(float), np.zeros((n, k), np.int8 if k < 128 else np.int16)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        moved = switch > best
        back[i] = np.where(moved, top, stay)
        best = np.where(moved, switch, best) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label(texts: list[str | None], model: dict, penalty: float = 12.0) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans as (start, end, language) in code points) of each text."""
    names = model["languages"]
    points, starts, ends, script, counts = cut(texts)
    if not names or not len(starts):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    h, first = trigrams(points, starts, ends)
    words = np.add.reduceat(model["score"][h], first, axis=0)
    allowed = model["script"][script]
    allowed |= ~allowed.any(1, keepdims=True)
    words[~allowed] = words.min() - 50.0
    out, at, offset = [], 0, 0
    for text, n in zip(texts, counts.tolist()):
        if n == 0:
            out.append((UNKNOWN, 0.0, []))
        else:
            path = best_path(words[at:at + n], penalty)
            length = ends[at:at + n] - starts[at:at + n]
            held = np.bincount(path, length, len(names))
            winner = int(np.argmax(held))
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), n]
            spans = [(int(starts[at + a]) - offset, int(ends[at + b - 1]) - offset, names[path[a]]) for a, b in zip(cuts, cuts[1:])]
            out.append((names[winner], float(held[winner] / held.sum()), spans))
        at += n
        offset += 1 if text is None else len(text) + 1
    return out


def identify(docs: DataFrame, model: dict, penalty: float = 12.0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score (share of letters in that language), spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        got = label(batch.column("text_").to_pylist(), shared.value, penalty)
        return {c: batch.column(c) for c in keep} | {
            "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
            "spans": [[{"start": a, "end": b, "lang": c} for a, b, c in g[2]] for g in got],
        }

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    return by_batches(docs.select(*keep, F.col(text).alias("text_")), work, schema, "text_")


def accept(docs: DataFrame, model: dict, least_score: float = 0.4, penalty: float = 12.0) -> DataFrame:
    """documents whose language is known and holds at least least_score of their letters."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def work(batch):
        import pyarrow as pa

        got = label(batch.column("text").to_pylist(), shared.value, penalty)
        kept = batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least_score for g in got], pa.bool_()))
        return {c: kept.column(c) for c in names}

    return by_batches(docs, work, docs.schema, "text")
