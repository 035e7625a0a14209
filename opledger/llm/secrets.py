"""Secret scan: fixed patterns, and password guess costs on values in credential context.

The base patterns give spans of three kinds.  Beside them every value that
stands in credential context (a key word, then a separator) is priced: the
least cost, over all cuts of the value into words, dates, repeats, keyboard
walks and brute-force spans, of guessing it.  Words are ranked by the public
vocabulary (about 27,000 of four letters and more, most of them English), so clean prose is cheap.  A value that costs more than
`log10_guesses` is a further span of kind `guess`, unless one base span covers it
wholly; it may overlap base spans.

Edge cases: a null or empty text has no spans; values of any length are priced
by one recurrence over the whole value, in linear time, and the cost is the least
of all cuts; of cuts of one cost any may be named; repeated rows give repeated
rows; an empty table gives no row; scan reads only key and text, redact keeps
all columns.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import by_batches
from .subwords import encoder, vocabulary_path

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

# Words that announce a credential.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth(?:orization)?|bearer|credentials?)["']?[\x20\t]*(?:[:=]|\bis\b)[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
# The most guessed passwords and words, by rank.
COMMON = """password 123456 qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football
baseball iloveyou trustno1 superman batman secret changeme default test guest root user token key pass hello
freedom whatever summer winter spring autumn love star god king queen access database server example your
none null true false changeit temp demo sample placeholder insert here the and for you with that this from""".split()
LONGEST_WORD = 20
#: Repeats start at most so far into a maximal run: later starts never pay.
DEEPEST = 24
# Rows of the usual keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("430157@$!", "aeoistasi")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {a + b for x, y in zip(ROWS, ROWS[1:]) for a, b in zip(x, y)} | {b + a for x, y in zip(ROWS, ROWS[1:]) for a, b in zip(x, y)}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


@lru_cache(maxsize=1)
def ranks() -> dict[str, int]:
    """Rank of every known word: the common ones, then the words of the public vocabulary, whose ids follow frequency."""
    pieces = sorted(encoder(vocabulary_path()).library.get_vocab().items(), key=lambda x: x[1])
    words = (t.removeprefix("Ġ").lower() for t, _ in pieces)
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *(w for w in words if 4 <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha())]))}


def _spread(part: str) -> int:
    """Size of the smallest usual alphabet that holds the characters."""
    size = 0
    if any(c.islower() for c in part):
        size += 26
    if any(c.isupper() for c in part):
        size += 26
    if any(c.isdigit() for c in part):
        size += 10
    if any(not c.isalnum() for c in part):
        size += 33
    return max(size, 10)


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for a value, and the segments (kind, start, end) of the cheapest cut."""
    n, lower, known = len(value), value.lower(), ranks()
    plain = lower.translate(LEET) if len(lower.translate(LEET)) == n else lower
    per_character = math.log10(_spread(value))
    # cheapest cuts of the first i characters, by whether their last segment is brute force: only such a one goes on at no further segment
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute_from = [0] * (n + 1)
    joint = math.log10(2.0)  # each further segment doubles the orders to try
    # equal[u][i]: how many characters from i on equal the one u further
    equal = {u: [0] * (n + 1) for u in (1, 2, 3, 4)}
    for unit, run in equal.items():
        for i in range(n - unit - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + unit] else 0
    deep = dict.fromkeys(equal, 0)
    walk, walk_from, step = math.inf, 0, math.log10(2.5)  # the cheapest keyboard walk that ends here
    for i in range(n + 1):
        if i >= 2:
            walk = walk + step if lower[i - 2:i] in NEXT else math.inf
            if i >= 3 and lower[i - 2:i] in NEXT and lower[i - 3:i - 1] in NEXT:
                start = min(best[i - 3], brute[i - 3]) + (joint if i > 3 else 0.0) + math.log10(47.0) + 2 * step
                if start < walk:
                    walk, walk_from = start, i - 3
            if walk < best[i]:
                best[i], back[i] = walk, ("walk", walk_from)
        if i == n:
            break
        here = min(best[i], brute[i]) + (joint if i else 0.0)
        begun = best[i] + (joint if i else 0.0)
        brute[i + 1], brute_from[i + 1] = (brute[i] + per_character, brute_from[i]) if brute[i] <= begun else (begun + per_character, i)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):  # words
            rank = known.get(lower[i:j])
            extra = 0.0
            if rank is None:
                rank, extra = known.get(plain[i:j]), math.log10(4.0)
            if rank is not None:
                extra += math.log10(2.0) * (value[i:j] != lower[i:j])
                cost = here + math.log10(rank + 1) + extra
                if cost < best[j]:
                    best[j], back[j] = cost, ("word", i)
        date = DATE.match(value, i)
        if date:
            j = date.end()
            cost = here + (math.log10(365 * 120.0) if j - i > 4 else math.log10(120.0))
            if cost < best[j]:
                best[j], back[j] = cost, ("date", i)
        for unit, run in equal.items():  # repeats
            deep[unit] = deep[unit] + 1 if i and run[i - 1] else 0
            if deep[unit] < DEEPEST:
                for j in range(i + 2 * unit, i + unit + run[i] // unit * unit + 1, unit):
                    if j - i >= 3:
                        cost = here + unit * per_character + math.log10((j - i) / unit)
                        if cost < best[j]:
                            best[j], back[j] = cost, ("repeat", i)
    cuts, at, least = [], n, min(best[n], brute[n])
    while at:
        kind, start = ("brute", brute_from[at]) if brute[at] < best[at] else back[at]
        cuts.append((kind, start, at))
        at = start
        if kind == "brute" and at:  # a new span of brute force only follows another kind
            cuts.append((*back[at], at))
            at = back[at][1]
    return least, cuts[::-1]


def spans_of(text: str | None, log10_guesses: float = 10.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, rank of kind, end) of the base spans, and of those that guess costs add."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    for m in CONTEXT.finditer(text):
        lo, hi = m.span(1)
        while hi > lo and text[hi - 1] in ".)]}!?:":
            hi -= 1
        if hi - lo >= 6 and not any(a <= lo and hi <= b for a, _, b in base) and guess_cost(text[lo:hi])[0] >= log10_guesses:
            added.append((lo, 3, hi))
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, log10_guesses: float = 10.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts of base spans, their digest and all spans.

    Columns: key, n_assign, n_access, n_hex, base_sha256, spans, n_guess.
    """

    def work(batch):
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
        for value in batch.column("text").to_pylist():
            base, added = spans_of(value, log10_guesses)
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                out[c].append(sum(1 for s in base if s[1] == k))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(sorted(base + added)))
            out["n_guess"].append(len(added))
        return out | {key: batch.column(key)}

    kind = dict(docs.dtypes)[key]
    return by_batches(docs.select(key, docs[text].alias("text")), work, f"{key} {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint", "text")


def redact(docs: DataFrame, mark: str = "[SECRET]", log10_guesses: float = 10.0) -> DataFrame:
    """documents with the found spans replaced by a mark and n_chars counted anew; no row goes."""
    names = docs.columns

    def clean(value):
        if not value:
            return value
        base, added = spans_of(value, log10_guesses)
        if not base and not added:
            return value
        parts, at = [], 0
        for a, _, b in sorted(base + added):
            if b <= at:
                continue
            if a >= at:
                parts += [value[at:a], mark]
            at = b
        return "".join([*parts, value[at:]])

    def work(batch):
        made = [clean(v) for v in batch.column("text").to_pylist()]
        out = {n: batch.column(n) for n in names} | {"text": made}
        if "n_chars" in names:
            out["n_chars"] = [n if t == v or t is None else len(t) for n, v, t in zip(batch.column("n_chars").to_pylist(), batch.column("text").to_pylist(), made)]
        return out

    return by_batches(docs, work, docs.schema, "text")
