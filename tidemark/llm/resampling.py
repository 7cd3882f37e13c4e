"""Quality classification by importance resampling.

Target and raw texts are each modelled by the frequencies of their hashed n-grams (lower-cased words and word
pairs, BUCKETS buckets, add-one smoothing). A document's log importance weight is the sum over its n-grams of the
log ratio of the two models. Adding Gumbel noise to the log weights and keeping the k largest draws k documents
without replacement in proportion to their weights.

The k-th largest key is found exactly without sorting or collecting keys: keys are 64-bit numbers, and four
counts by 16 bits each narrow it down, every one over all rows. Counts of n-grams cover all texts.

Edge cases: a null or empty text has weight 0 in logs, like a text that both models find as likely; noise depends on
doc_id and text (ids may be null), so repeated rows are kept or dropped together, and ties at the k-th key are all kept, so that
more than k rows may be; without a target
all ratios are 0; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

BUCKETS = 10_000
SEED = 42
#: Words whose hashes a Python worker remembers, and bytes of such.
CACHE, LONGEST = 200_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED) & 0x7FFFFFFFFFFFFFFF
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def buckets(text: bytes, hashes: dict) -> np.ndarray:
    """The buckets of a text's words, then of its word pairs."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(3)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h, pairs ^ pairs >> np.uint64(29)]) % np.uint64(BUCKETS)


def counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """texts: (text, target boolean). Counts of each bucket over all rows, and over the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros((2, BUCKETS), dtype=np.int64), _Hashes()
        for batch in batches:
            found = {True: [], False: []}
            for x, t in zip(common.encoded(batch.column("text").to_pylist()), batch.column("target").to_pylist(), strict=True):
                found[t].append(buckets(x, hashes).astype(np.uint16))
            for t, some in found.items():
                n = np.bincount(np.concatenate(some), minlength=BUCKETS) if some else 0
                total[0] += n
                total[1] += n if t else 0
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "raw", "target"])

    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw frequency for each bucket."""
    if not target.any():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weigh(text: Column, doc_id: Column, ratio: np.ndarray, seed: int = SEED) -> Column:
    """A struct (log_weight, score, place) for each row: score is the weight with noise, place the score as a whole number in the same order."""

    @F.arrow_udf("struct<log_weight:double,score:double,place:long>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import xxhash

        hashes = _Hashes()
        for texts, ids in batches:
            b = common.encoded(texts.to_pylist())
            w = np.array([ratio[buckets(x, hashes).astype(np.int64)].sum() for x in b], dtype=np.float64)
            noise = [xxhash.xxh64_intdigest(f"{i}:{xxhash.xxh64_hexdigest(x, seed)}", seed) for i, x in zip(ids.to_pylist(), b, strict=True)]
            u = np.array([(x >> 11) + 0.5 for x in noise], dtype=np.float64) / 2.0**53
            s = w - np.log(-np.log(u)) if len(w) else w
            bits = (s + 0.0).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(w), pa.array(s), pa.array(np.where(bits < 0, bits ^ 0x7FFFFFFFFFFFFFFF, bits))], ["log_weight", "score", "place"])

    return run(text, doc_id)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs without nulls; None if there are fewer or k is 0."""
    if k <= 0:
        return None
    high = 0  # the bits found so far, of the number with its sign bit flipped
    for shift in (48, 32, 16, 0):
        x = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
        left = df if shift == 48 else df.where(F.shiftrightunsigned(x, shift + 16) == high)
        digit = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF))
        found = left.groupBy(digit.alias("digit")).count().collect()  # at most 65,536 rows
        for r in sorted(found, key=lambda r: -r["digit"]):
            if k <= r["count"]:
                high = high << 16 | r["digit"]
                break
            k -= r["count"]
        else:
            return None
    return (high ^ 1 << 63) - (1 << 64) if (high ^ 1 << 63) >= 1 << 63 else high ^ 1 << 63


def resample(docs: DataFrame, target_ids: DataFrame, share: float, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, score, kept): the documents drawn are ``share`` of all, at least one.

    target_ids: the distinct ids (``target_id``) of the documents that make up the target, materialized.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    flagged = d.join(common.small(target_ids), d["doc_id"] == target_ids["target_id"], "left").select("text", F.col("target_id").isNotNull().alias("target"))
    raw, target = counts(flagged)
    weighed = common.materialize(d.select("doc_id", weigh(F.col("text"), F.col("doc_id"), log_ratio(raw, target), seed).alias("x")).select("doc_id", "x.*"), "weights")
    n = weighed.count()
    least = kth_largest(weighed, "place", max(1, math.floor(share * n + 0.5)) if n else 0)
    kept = F.lit(False) if least is None else F.col("place") >= least
    return weighed.select("doc_id", "log_weight", "score", kept.alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic. Share: that of good ones among the labelled."""
    labels = common.table(spark, sf_dir, "labels").where("doc_id is not null")
    by = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad"))
    by = common.materialize(by, "labels")
    good = by.where("good = 1 and bad = 0").select(F.col("doc_id").alias("target_id"))
    share = by.agg(F.avg("good")).first()[0]
    return resample(common.texts(spark, sf_dir, "documents"), good, 1.0 if share is None else share)
