"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

The trees (numpy, logistic loss, histogram splits) learn from labelled URLs; a
URL is labelled where a rule fits it.  Features are the lengths, depth, digit
ratio, entropy and parameter counts of the URL and smoothed block rates of its
host suffixes and first path part, counted over all labelled URLs.  While the
trees are fitted, the rates of a URL leave out the fold of its host.

The trees are fitted on at most `most_rows` labelled URLs, those with the
smallest hash; counts, rules and predictions cover every row.

Edge cases: a null URL or one without `://` has an empty host and path and goes
to the trees; without labelled URLs, or with labels of one kind only, every
other URL gets that one kind, or `allow`; of equally good splits the first is
taken, and a score at the threshold blocks; repeated rows give repeated rows;
very long URLs are used whole; an empty table gives no row; columns other than
key and URL are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, discard, kept

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
NUMERIC = 14
FOLDS = 5


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, both empty without `://`."""
    rest = F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url))
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.when(known, host).otherwise(""), "path": F.when(known, path).otherwise("")})


def rule_of(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def rate_keys() -> list[Column]:
    """What block rates are counted by: last label, last two labels, first path part, and the first and third together."""
    last, first = F.substring_index("host", ".", -1), F.regexp_extract("path", r"^/*([^/]*)", 1)
    return [last, F.substring_index("host", ".", -2), first, F.concat(last, F.lit("/"), first)]


def fold() -> Column:
    """The fold of a URL, by its host, so that the pages of one host are held out together."""
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def _by_key() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("k")) for i, k in enumerate(rate_keys())])).alias("by")


def rate_counts(ruled: DataFrame) -> tuple[DataFrame, int, int]:
    """kind, k, fold, seen, bad (kept) over all labelled URLs; the number of these and of the blocked ones."""
    labelled = ruled.filter("fit is not null").select(_by_key(), fold().alias("fold"), (F.col("fit.verdict") == "block").cast("bigint").alias("block"))
    counts = kept(labelled.groupBy("by.kind", "by.k", "fold").agg(F.count("*").alias("seen"), F.sum("block").alias("bad")), "rates")
    n, bad = counts.filter("kind = 0").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    return counts, n, bad


def _rate(prior: float) -> Column:
    return (F.coalesce("bad", F.lit(0)) + 5 * prior) / (F.coalesce("seen", F.lit(0)) + 5)


def with_rates(rows: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """Adds rates: smoothed block rates by rate_keys, of all labelled URLs."""
    keys, total = rate_keys(), counts.groupBy("kind", "k").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    out = rows.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    for i in range(len(keys)):
        out = out.join(total.filter(f"kind = {i}").select(F.col("k").alias(f"k{i}"), _rate(prior).alias(f"r{i}")), f"k{i}", "left")
    names = [f"r{i}" for i in range(len(keys))]
    return out.withColumn("rates", F.array(*[F.coalesce(r, F.lit(prior)) for r in names])).drop(*names, *[f"k{i}" for i in range(len(keys))])


def with_rates_of_others(sample: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """Adds rates that leave out the URL's own fold, so that no label is among its own features (columns url, host, path)."""
    each = sample.select("url", "host", "path").distinct().select("url", fold().alias("own"), _by_key()).select("url", "own", "by.kind", "by.k")
    met = each.join(counts, ["kind", "k"], "left")
    other = F.col("fold") != F.col("own")
    sums = met.groupBy("url", "kind").agg(F.sum(F.when(other, F.col("seen"))).alias("seen"), F.sum(F.when(other, F.col("bad"))).alias("bad"))
    rates = sums.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("kind", _rate(prior).alias("rate")))).alias("r"))
    return sample.join(rates.select("url", F.col("r.rate").alias("rates")), "url")


def features(urls: list[str | None], hosts: list[str], paths: list[str], rates: list[list[float]]) -> np.ndarray:
    """Lexical features of URLs, then their block rates; one row each."""
    urls = [u or "" for u in urls]
    n, out = len(urls), np.zeros((len(urls), NUMERIC))
    size = np.array([len(u) for u in urls], np.int64)
    points = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    held = np.maximum(size, 1)
    cell, count = np.unique(owner << 21 | points, return_counts=True)
    share = count / held[cell >> 21]
    queries = [u.partition("?")[2].partition("#")[0] for u in urls]
    lasts = [p.rstrip("/").rpartition("/")[2] for p in paths]
    of = lambda values: np.fromiter(values, float, n)
    for j, column in enumerate((
        size, of(len(h) for h in hosts), of(len(p) for p in paths), of(sum(x != "" for x in p.split("/")) for p in paths),
        np.bincount(owner, (points >= 48) & (points <= 57), n) / held, -np.bincount(cell >> 21, share * np.log2(share), n),
        of(sum(x != "" for x in q.split("&")) for q in queries), of(len(q) for q in queries), of(h.count(".") for h in hosts),
        np.bincount(owner, (points == 45) | (points == 95), n), of(u.startswith("https") for u in urls), of(len(x) for x in lasts),
        of("." in x for x in lasts), of(p.endswith("/") for p in paths),
    )):
        out[:, j] = column
    return np.concatenate([out, np.array(rates, float).reshape(n, -1)], 1)


class Trees:
    """Gradient-boosted regression trees for a logistic loss, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        b = self._binned(x)
        p = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            self._grow(tree, b, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, b)
        return self

    def _grow(self, tree, b, g, h, rows, depth) -> int:
        at = len(tree)
        tree.append(())
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if depth and len(rows) > 1:
            whole = total_g**2 / (total_h + self.penalty)
            for j in range(b.shape[1]):
                column = b[rows, j]
                gs = np.cumsum(np.bincount(column, g[rows], len(self.edges[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(column, h[rows], len(self.edges[j]) + 1))[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + self.penalty) + (total_g - gs) ** 2 / (total_h - hs + self.penalty) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            tree[at] = (-1, 0, 0, 0, -self.rate * float(total_g) / (float(total_h) + self.penalty))
            return at
        _, j, k = best
        left = b[rows, j] <= k
        lo = self._grow(tree, b, g, h, rows[left], depth - 1)
        hi = self._grow(tree, b, g, h, rows[~left], depth - 1)
        tree[at] = (j, k, lo, hi, 0.0)
        return at

    @staticmethod
    def _walk(tree, b) -> np.ndarray:
        out = np.zeros(len(b))
        todo = [(0, np.arange(len(b)))]
        while todo:
            at, rows = todo.pop()
            j, k, lo, hi, value = tree[at]
            if j < 0:
                out[rows] = value
            else:
                left = b[rows, j] <= k
                todo += [(lo, rows[left]), (hi, rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, b) for t in self.trees))))


def fit(sample: list[tuple], n: int, bad: int) -> dict:
    """A model from (url, host, path, rates, verdict) rows, of n labelled URLs with bad blocked ones: trees and the prior."""
    prior = bad / n if n else 0.0
    if bad in (0, n):
        return {"trees": None, "prior": prior}
    *columns, verdicts = zip(*sample)
    return {"trees": Trees().fit(features(*map(list, columns)), np.array([v == "block" for v in verdicts], float)), "prior": prior}


def learn(ruled: DataFrame, most_rows: int = 20_000) -> tuple[dict, DataFrame]:
    """The model and the counts of block rates, from rows with url, host, path and fit."""
    counts, n, bad = rate_counts(ruled)
    order = F.xxhash64("url")
    sample = kept(ruled.filter("fit is not null").select("url", "host", "path", F.col("fit.verdict").alias("verdict")).orderBy(order, "url").limit(most_rows), "sample")
    rows = with_rates_of_others(sample, counts, bad / n if n else 0.0).orderBy(order, "url").collect()
    discard(sample)
    return fit([(r.url, r.host, r.path, r.rates, r.verdict) for r in rows], n, bad), counts


def judge(pages: DataFrame, rules=RULES, most_rows: int = 20_000, threshold: float = 0.5, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and block_score (null where a rule decides) of every URL.

    most_rows bounds the labelled URLs that the trees are fitted on.
    """
    ruled = with_parts(pages.select(F.col(key).alias("key_"), F.col(url).cast("string").alias("url"))).withColumn("fit", rule_of(rules))
    made, counts = learn(ruled, most_rows)
    model = pages.sparkSession.sparkContext.broadcast(made)
    kind = dict(pages.dtypes)[key]

    def work(batch):
        m = model.value
        urls, hosts, paths, rates = (batch.column(c).to_pylist() for c in ("url", "host", "path", "rates"))
        score = m["trees"].probability(features(urls, hosts, paths, rates)).tolist() if m["trees"] is not None else [m["prior"]] * len(urls)
        block = [s >= threshold and (m["trees"] is not None or s > 0) for s in score]
        return {"key_": batch.column("key_"), "host": hosts, "path": paths, "verdict": ["block" if b else "allow" for b in block], "block_score": score}

    open_ = with_rates(ruled.filter("fit is null").select("key_", "url", "host", "path"), counts, made["prior"])
    judged = by_batches(open_, work, f"key_ {kind}, host string, path string, verdict string, block_score double", "url")
    sure = ruled.filter("fit is not null").select("key_", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    both = sure.unionByName(judged.withColumn("rule", F.lit(None).cast("string")))
    return both.select(F.col("key_").alias(key), "host", "path", "rule", "verdict", "block_score")
