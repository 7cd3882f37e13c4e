"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host suffix and a path prefix; the longest that fits decides. Where none fits, trees decide, trained
on labelled URLs: lengths, depth, digit ratio, entropy, parameter counts, and statistics of three suffixes (last
host label, last two, file extension): how many of all URLs have the suffix, and the spread of their lengths. Rates of
labels by suffix are no features: labels come from rules on suffixes, so such rates would only repeat the rules and
block whole suffixes of which a few paths are labelled. For the same reason the trees learn from domains that have
labels of both kinds, found exactly (from all, if there are none): one with a single label says nothing about its URLs' words. Both
labels weigh the same in all.

Learning reads a bounded sample: of the distinct labelled URLs of these domains SAMPLE_ROWS at most are drawn by hash, so
that copies of one can't fill the sample, and their features come to the driver. Suffix statistics cover all rows and are exact for the FREQUENT most frequent suffixes of each kind; each
other suffix counts as the mean of those in its hashed bucket, of BUCKETS. So the model has a fixed size.

Edge cases: a null URL or one without ``://`` has an empty host and path and no rule; without labels of both kinds
every verdict left to the method is the only kind there is, or allow; repeated rows get equal verdicts; extra columns
are carried along unread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Distinct labelled URLs that the trees are fit on, at most.
SAMPLE_ROWS = 20_000
#: Suffixes of each kind with statistics of their own, and buckets of the others.
FREQUENT, BUCKETS = 4_096, 1_024
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.15, 32, 20
LEXICAL = ("length", "host_length", "path_length", "query_length", "labels", "depth", "digits", "letters", "hyphens", "entropy", "parameters", "fragment", "secure", "longest_run", "segment_mean")
SUFFIXES = ("tld", "domain", "extension")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(h: Column, p: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The rule that decides (host and path, as text) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are asked first
        fits = ((h == of) | h.endswith("." + of)) & p.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(of + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(url: str | None) -> list[float]:
    """The features of LEXICAL."""
    u = url or ""
    n = len(u)
    scheme, _, rest = u.partition("://") if "://" in u else ("", "", u)
    body, _, fragment = rest.partition("#")
    body, _, query = body.partition("?")
    h, _, p = body.partition("/")
    counts = Counter(u)
    segments = [s for s in p.split("/") if s]
    run = longest = 0
    for c in u:
        run = run + 1 if c.isalnum() else 0
        longest = max(longest, run)
    return [
        n, len(h), len(p), len(query), h.count(".") + 1 if h else 0, len(segments), sum(map(str.isdigit, u)) / max(1, n), sum(map(str.isalpha, u)) / max(1, n), u.count("-"),
        -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0, len([x for x in query.split("&") if x]), float(bool(fragment)), float(scheme.lower() == "https"), longest,
        sum(map(len, segments)) / len(segments) if segments else 0.0,
    ]


def suffixes(h: Column, p: Column) -> list[Column]:
    """Hashes of the three suffixes."""
    tld, domain = F.substring_index(h, ".", -1), F.substring_index(h, ".", -2)
    extension = F.regexp_extract(p, r"\.([0-9A-Za-z]{1,8})$", 1)
    return [F.xxhash64(F.lit(k), x) for k, x in zip(SUFFIXES, (tld, domain, extension), strict=True)]


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into at most BINS bins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.bin(x)
        self.base = 0.0
        self.nodes: list[np.ndarray] = []  # per tree, per node: feature (-1: leaf), bin, value
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, w * (y - p), w * p * (1 - p))
            self.nodes.append(tree)
            f += RATE * self._walk(tree, binned)
        return self

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        size = (1 << DEPTH + 1) - 1
        tree = np.zeros((size, 3))
        tree[:, 0] = -1
        at = np.zeros(len(b), dtype=np.int64)
        wide = b.shape[1] * BINS
        for level in range(DEPTH + 1):
            first, n = (1 << level) - 1, 1 << level
            here = at >= first
            node = at[here] - first
            gs, hs = np.bincount(node, g[here], n), np.bincount(node, h[here], n)
            tree[first : first + n, 2] = gs / (hs + 1.0)
            if level == DEPTH:
                break
            flat = (node[:, None] * wide + np.arange(b.shape[1]) * BINS + b[here]).ravel()
            shape = (n, b.shape[1], BINS)
            gl = np.bincount(flat, np.repeat(g[here], b.shape[1]), n * wide).reshape(shape).cumsum(axis=2)
            hl = np.bincount(flat, np.repeat(h[here], b.shape[1]), n * wide).reshape(shape).cumsum(axis=2)
            cl = np.bincount(flat, minlength=n * wide).reshape(shape).cumsum(axis=2)
            gr, hr, cr = gs[:, None, None] - gl, hs[:, None, None] - hl, cl[:, :, -1:] - cl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gs**2 / (hs + 1))[:, None, None]
            gain = np.where((cl >= LEAST) & (cr >= LEAST), gain, 0).reshape(n, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(n), best] > 1e-6
            tree[first : first + n, 0] = np.where(split, best // BINS, -1)
            tree[first : first + n, 1] = best % BINS
            rows = np.flatnonzero(here)[split[node]]
            feature, cut = best[at[rows] - first] // BINS, best[at[rows] - first] % BINS
            at[rows] = 2 * at[rows] + 1 + (b[rows, feature] > cut)
        return tree

    @staticmethod
    def _walk(tree: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), dtype=np.int64)
        for _ in range(DEPTH):
            feature = tree[at, 0].astype(np.int64)
            go = feature >= 0
            at[go] = 2 * at[go] + 1 + (b[go, feature[go]] > tree[at[go], 1])
        return tree[at, 2]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the label 1."""
        b, f = self.bin(x), np.full(len(x), self.base)
        for t in self.nodes:
            f += RATE * self._walk(t, b)
        return 1 / (1 + np.exp(-f))


class Model:
    """Suffix statistics, and the trees; mean: the share of labels that block.

    frequent: for each kind of suffix hash, count, sum of lengths and of their squares; tail: (kind, 3, BUCKETS), means of the other suffixes of a bucket.
    """

    def __init__(self, frequent: list[np.ndarray], tail: np.ndarray, mean: float):
        self.mean = mean
        self.trees: Trees | None = None
        self.known, self.common, self.spread = [], [], []
        for f, t in zip(frequent, tail, strict=True):
            order = np.argsort(f[0])
            n, s, q = np.concatenate([f[1:, order].astype(np.float64), t], axis=1)  # the buckets follow the frequent ones
            self.known.append(f[0, order])
            self.common.append(np.log1p(n))
            self.spread.append(np.sqrt(np.maximum(0, q / np.maximum(n, 1e-9) - (s / np.maximum(n, 1e-9)) ** 2)))

    def features(self, urls: list[str | None], hashes: np.ndarray) -> np.ndarray:
        """hashes: a row for each URL, a column for each kind of suffix."""
        words = np.array([lexical(u) for u in urls], dtype=np.float64).reshape(len(urls), len(LEXICAL))
        at = np.zeros(hashes.shape, dtype=np.int64)
        for k, known in enumerate(self.known):
            at[:, k] = len(known) + hashes[:, k] % BUCKETS
            if len(known):
                near = np.minimum(np.searchsorted(known, hashes[:, k]), len(known) - 1)
                at[:, k] = np.where(known[near] == hashes[:, k], near, at[:, k])
        stats = [x[k][at[:, k]] for x in (self.common, self.spread) for k in range(len(SUFFIXES))]
        return np.concatenate([words, np.stack(stats, axis=1)], axis=1)


def feature_vector(url: Column, model: Model) -> Column:
    """The features of each URL as an array."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, hashes in batches:
            yield pa.array(list(model.features(urls.to_pylist(), _columns(hashes))), pa.list_(pa.float64()))

    return run(url, F.array(*suffixes(host(url), path(url))))


def _columns(hashes: pa.Array) -> np.ndarray:
    return hashes.values.to_numpy(zero_copy_only=False).reshape(len(hashes), len(SUFFIXES)) if len(hashes) else np.zeros((0, len(SUFFIXES)), dtype=np.int64)


def suffix_statistics(urls: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """What Model takes; urls: (url, hashes), all of them."""
    n = F.coalesce(F.length("url"), F.lit(0)).cast("double")
    sums = urls.select(n.alias("n"), F.posexplode("hashes").alias("k", "suffix")).groupBy("k", "suffix")
    sums = common.materialize(sums.agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")), "suffixes")
    frequent, tail = [], np.zeros((len(SUFFIXES), 3, BUCKETS))
    for k in range(len(SUFFIXES)):
        own = sums.where(F.col("k") == k)
        top = own.orderBy(F.desc("c"), "suffix").limit(FREQUENT).collect()
        # Longs and sums side by side: sums of this many rows fit longs as well.
        frequent.append(np.array([[r["suffix"], int(r["c"]), int(r["s"]), int(r["q"])] for r in top], dtype=np.int64).reshape(-1, 4).T)
        if len(top) == FREQUENT:
            less = (F.col("c") < top[-1]["c"]) | ((F.col("c") == top[-1]["c"]) & (F.col("suffix") > top[-1]["suffix"]))
            means = own.where(less).groupBy(F.pmod("suffix", F.lit(BUCKETS)).alias("bucket")).agg(F.avg("c").alias("c"), F.avg("s").alias("s"), F.avg("q").alias("q"))
            for r in means.collect():  # at most BUCKETS rows
                tail[k, :, r["bucket"]] = r["c"], r["s"], r["q"]
    return frequent, tail


def learn(urls: DataFrame, url: str = "url", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> Model:
    """urls: all URLs, with label 1 (block), 0 (allow) or null (not labelled)."""
    u = urls.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    known = u.agg(F.avg("label").alias("mean")).first()
    model = Model(*suffix_statistics(u.select("url", F.array(*suffixes(host(F.col("url")), path(F.col("url")))).alias("hashes"))), mean=known["mean"] or 0.0)
    if not 0 < model.mean < 1:
        return model
    u = u.where("label is not null").withColumn("domain", F.substring_index(host(F.col("url")), ".", -2))
    mixed = common.materialize(u.groupBy("domain").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("domain"), "mixed")
    if not mixed.isEmpty():
        u = u.join(common.small(mixed), "domain", "left_semi")
    labelled = u.select(F.xxhash64("url").alias("place"), "label").distinct().count()
    place = F.xxhash64("url").cast("double") / F.lit(2.0**64) + 0.5
    drawn = u.select("url", "label", place.alias("place")).where(F.col("place") < min(1.0, 1.1 * sample_rows / labelled)).distinct()
    rows = drawn.select("place", "label", feature_vector(F.col("url"), model).alias("x")).orderBy("place", "label", "x").limit(sample_rows).collect()
    if rows:
        model.trees = Trees().fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))
    return model


def block_score(url: Column, model: Model) -> Column:
    """The probability that each URL is to be blocked."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, hashes in batches:
            if model.trees is None:
                yield pa.array([model.mean] * len(urls), pa.float64())
            else:
                yield pa.array(model.trees.score(model.features(urls.to_pylist(), _columns(hashes))) if len(urls) else [], pa.float64())

    return run(url, F.array(*suffixes(host(url), path(url))))


def judge(urls: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """urls with host, path, rule, verdict and score, named with underscores appended where it has such columns.

    The URLs that a rule decides are the labelled ones that the trees learn from.
    """
    names = common.fresh(urls, "host", "path", "rule", "verdict", "score")
    h, p = host(F.col(url)), path(F.col(url))
    rule, verdict = apply_rules(h, p, rules)
    model = learn(urls.select(F.col(url).alias("url"), (verdict == "block").cast("int").alias("label")))
    out = urls.withColumns(dict(zip(names[:3], (h, p, rule), strict=True))).withColumn(names[4], block_score(F.col(url), model))
    chosen = F.when(F.col(names[4]) >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn(names[3], F.coalesce(verdict, chosen))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.texts(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
