"""Near duplicates by SimHash.

Texts get 64-bit fingerprints of their three-word shingles; fingerprints that differ in at most three
bits are linked, and linked documents form components.

Candidates come from pigeonhole blocks: the 64 bits are cut into six blocks, of which three differing
bits can touch three at most, so a close pair agrees on at least one of the 20 choices of three blocks.
A choice fixes 31 to 33 bits, so at 30 billion documents a bucket holds about seven strangers. Within a
bucket a breadth-first walk over distinct fingerprints links each to the rest: it writes one verified
link for each fingerprint joined, never all pairs. A bucket of more than BUCKET fingerprints is passed
on to a second round, which cuts its free bits into eight parts of which five must agree: then at most
13 bits are free, so a bucket holds at most 8,192 fingerprints. No link is lost in either round.

The pipeline's stage asks for more: documents whose five-word shingles have a similarity of 0.8 or more. Three bits of
64 don't find those (they differ in about ten), and no choice of blocks of 64 bits would at this scale. So there each
text has a wide fingerprint as well, of 512 bits over its distinct five-word shingles, and two are candidates if at most LOOSE
bits differ. Candidates only tell which texts to compare: in each of their components all pairs are held against the exact
similarity of their sets of shingles (as 64-bit hashes), and linked from 0.8 on. Blocks for these are samples: the shingles' hashes fall into 16 ranges, and a block is the
five smallest of a range. A pair of similarity 0.8 agrees on a block with a chance of a third, on one of sixteen with 99.8 %.
Buckets are walked as above, those of over BUCKET fingerprints in a round of their own; one of over WALK there is cut
into chunks, and each pair of chunks is walked in a bucket of its own, so no link is lost. The stage's links are both kinds.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer
than three words is one shingle; equal texts share a fingerprint and so a component; a null doc_id is
never the smallest of its component unless it is alone; an empty table gives an empty result; extra columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that are compared at once; larger buckets are cut finer.
BUCKET = 4_096
#: Shingle hashes whose bits are counted at once.
CHUNK = 65_536
#: Wide fingerprints: words of a shingle, 64-bit words, most bits that differ (similarity 0.8 has 77 of 512 on average, 0.7 has 98, with a deviation of 8).
WIDE_SHINGLE, WIDE, FAR = 5, 8, 88
#: Most bits that differ of candidates whose exact similarity is asked for: five deviations over the mean at 0.8.
LOOSE = 118
#: Ranges of shingle hashes (a power of two), and hashes of a range that make up its block.
RANGES, SAMPLE = 16, 5
#: Candidates are linked from a similarity of so many fifths on. Texts, and bytes of their shingles' hashes, of a chunk that is compared at once.
FIFTHS, TEXTS, BYTES = 4, 2_048, 16 << 20
#: Wide fingerprints of a large bucket that are compared at once; of more, each pair of chunks of half as many is.
WALK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(bits: list[int], widths: list[int]) -> list[int]:
    """Masks of consecutive runs of the given bits."""
    ends = list(accumulate(widths))
    return [sum(1 << b for b in bits[e - w : e]) for e, w in zip(ends, widths, strict=True)]


MASKS = [a | b | c for a, b, c in combinations(_blocks(list(range(64)), [11, 11, 11, 11, 10, 10]), 3)]


def _finer(mask: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    parts = _blocks(free, [len(free) // 8 + (i < len(free) % 8) for i in range(8)])
    return [mask | sum(x) for x in combinations(parts, 5)]


FINER = [_finer(m) for m in MASKS]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprints of UTF-8 texts, as unsigned 64-bit numbers."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= SHINGLE:
            out[k] = xxh64_intdigest(joined, SEED)
            continue
        n = len(words) - SHINGLE + 1
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, n, CHUNK):
            h = np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[i : min(n, i + CHUNK)], ends[i + SHINGLE - 1 :], strict=False)), dtype=">u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            for j in range(0, len(bits), 255):  # a sum of 255 bits fits a byte: eight times faster than wider sums
                counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
        out[k] = weights[2 * counts > n].sum(dtype=np.uint64)
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprints(common.encoded(texts.to_pylist())).view(np.int64))

    return run(text)


def walk(found: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that join distinct fingerprints as all pairs within distance would."""
    rest = found[1:]
    near, far, queue = [], [], [found[0]]
    while len(rest):
        if not queue:
            queue.append(rest[0])
            rest = rest[1:]
            continue
        x = queue.pop()
        close = np.bitwise_count(rest ^ x) <= distance
        new = rest[close]
        if len(new):
            near.append(np.full(len(new), x))
            far.append(new)
            queue.extend(new)
            rest = rest[~close]
    empty = found[:0]
    return np.concatenate([empty, *near]), np.concatenate([empty, *far])


def shingle_hashes(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's five-word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[min(WIDE_SHINGLE, len(words)) - 1 :], strict=False) if words else ()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans), dtype=np.uint64))


def sketch(text: bytes) -> tuple[bytes, list[int | None]]:
    """The wide fingerprint of a UTF-8 text and its sample blocks, null for ranges that none of its shingles fall into."""
    from xxhash import xxh64_intdigest

    h = shingle_hashes(text)
    if not len(h):
        return bytes(8 * WIDE), [None] * RANGES
    salts = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * WIDE, dtype=np.int64)
    for i in range(0, len(h), CHUNK // WIDE):
        x = h[i : i + CHUNK // WIDE, None] + salts
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    edges = [*np.searchsorted(h, np.arange(RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)), len(h)]
    blocks = [_signed(xxh64_intdigest(h[a : min(b, a + SAMPLE)].tobytes(), SEED)) if b > a else None for a, b in zip(edges, edges[1:], strict=False)]
    return np.packbits(2 * counts > len(h)).tobytes(), blocks


def sketched(text: Column) -> Column:
    """A struct (fp, wide, blocks) for each text."""

    @F.arrow_udf("struct<fp:long,wide:binary,blocks:array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            b = common.encoded(texts.to_pylist())
            wide, blocks = list(zip(*map(sketch, b), strict=True)) or ((), ())
            yield pa.StructArray.from_arrays(
                [pa.array(fingerprints(b).view(np.int64)), pa.array(wide, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))], ["fp", "wide", "blocks"]
            )

    return run(text)


def walk_wide(fp: np.ndarray, wide: np.ndarray, distance: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fp of rows whose wide fingerprints (rows of words) are within distance, as all pairs would join them."""
    rest, near, far, queue = np.arange(len(fp)), [fp[:0]], [fp[:0]], []
    left = wide
    while len(rest):
        if not queue:
            queue.append(rest[0])
            rest, left = rest[1:], left[1:]
            continue
        x = queue.pop()
        close = np.bitwise_count(left ^ wide[x]).sum(axis=1, dtype=np.int32) <= distance
        if close.any():
            new = rest[close]
            near.append(np.full(len(new), fp[x]))
            far.append(fp[new])
            queue.extend(new)
            rest, left = rest[~close], left[~close]
    a, b = np.concatenate(near), np.concatenate(far)
    return a[a != b], b[a != b]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int32())])


def _bucket_links(keyed: DataFrame, masks: list[int] | None, bucket: int | None) -> DataFrame:
    """keyed: (k, key, fp), all rows of a bucket in one partition and next to each other.

    Rows (a, b, null) are links. Rows (fp, null, k) belong to buckets that are too large here. Where masks are
    given, a link is written only in the first bucket that its two ends share; the others need no copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None if masks is None else np.array(masks, dtype=np.uint64)
        none = np.empty(0, np.uint64)
        k0, key0, fp0 = np.empty(0, np.int32), np.empty(0, np.int64), none
        passing = None

        def out(a, b, k=None):
            n = len(a)
            yield from pa.Table.from_arrays(
                [pa.array(a.view(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64)), pa.nulls(n, pa.int32()) if k is None else pa.array(k)], schema=_PAIR
            ).to_batches(max_chunksize=10_000)

        def links(k, f):
            f = np.unique(f)
            if len(f) < 2:
                return none, none
            a, b = walk(f)
            if order is not None and len(a):
                first = np.argmax((a ^ b)[:, None] & order[None, :] == 0, axis=1) == k
                a, b = a[first], b[first]
            return a, b

        def solve(k, key, fp):
            """Whole buckets."""
            edge = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], edge])
            sizes = np.diff(np.concatenate([starts, [len(k)]]))
            a, b, big, n = [], [], [], 0
            two = starts[sizes == 2]
            if len(two):
                x, y = fp[two], fp[two + 1]
                ok = (np.bitwise_count(x ^ y) <= DISTANCE) & (x != y)
                if order is not None:
                    ok[ok] &= np.argmax((x ^ y)[ok][:, None] & order[None, :] == 0, axis=1) == k[two][ok]
                a.append(x[ok])
                b.append(y[ok])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if bucket is not None and n > bucket:
                    big.append((s, n))
                    continue
                x, y = links(k[s], fp[s : s + n])
                a.append(x)
                b.append(y)
            if a:
                yield from out(np.concatenate(a), np.concatenate(b))
            for s, n in big:
                yield from out(fp[s : s + n], None, k[s : s + n])

        for batch in batches:
            k = np.concatenate([k0, batch.column("k").to_numpy()])
            key = np.concatenate([key0, batch.column("key").to_numpy()])
            fp = np.concatenate([fp0, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(k):
                continue
            if passing is not None:
                n = len(k) if (k[-1], key[-1]) == passing else int(np.argmax((k != passing[0]) | (key != passing[1])))
                yield from out(fp[:n], None, k[:n])
                k, key, fp = k[n:], key[n:], fp[n:]
                if not len(k):
                    k0, key0, fp0 = k, key, fp
                    continue
                passing = None
            same = (k == k[-1]) & (key == key[-1])
            last = len(k) - int(np.argmax(~same[::-1])) if not same.all() else 0
            if last:
                yield from solve(k[:last], key[:last], fp[:last])
            k0, key0, fp0 = k[last:], key[last:], fp[last:]
            if bucket is not None and len(k0) > bucket:
                passing = (k0[0], key0[0])
                yield from out(fp0, None, k0)
                k0, key0, fp0 = k0[:0], key0[:0], fp0[:0]
        if len(k0):
            yield from solve(k0, key0, fp0)

    return keyed.mapInArrow(run, "a long, b long, k int")


def _sample_links(keyed: DataFrame, most: int | None, distance: int) -> DataFrame:
    """keyed: (k, key, fp, wide), all rows of a bucket in one partition and next to each other.

    Rows (a, b, null) are links. A bucket of over ``most`` rows, if given, is passed on as rows (fp, null, k).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key = fp = np.empty(0, np.int64)
        wide = np.empty((0, WIDE), np.uint64)
        passing = None

        def out(a, b=None, k=None):
            yield from pa.Table.from_arrays(
                [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.int32()) if k is None else pa.array(np.full(len(a), k, dtype=np.int32))], schema=_PAIR
            ).to_batches(max_chunksize=10_000)

        def solve(k, key, fp, wide):
            """Whole buckets."""
            starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1])
            sizes = np.diff(np.concatenate([starts, [len(k)]]))
            two = starts[sizes == 2]
            two = two[(np.bitwise_count(wide[two] ^ wide[two + 1]).sum(axis=1, dtype=np.int32) <= distance) & (fp[two] != fp[two + 1])]
            yield from out(fp[two], fp[two + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if most is not None and n > most:
                    yield from out(fp[s : s + n], None, k[s])
                else:
                    yield from out(*walk_wide(fp[s : s + n], wide[s : s + n], distance))

        for batch in batches:
            k, key, fp = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((k, "k"), (key, "key"), (fp, "fp")))
            wide = np.concatenate([wide, np.frombuffer(b"".join(batch.column("wide").to_pylist()), dtype=np.uint64).reshape(-1, WIDE)])
            if passing is not None and len(k):
                other = np.flatnonzero((k != passing[0]) | (key != passing[1]))
                n = int(other[0]) if len(other) else len(k)
                yield from out(fp[:n], None, passing[0])
                k, key, fp, wide = k[n:], key[n:], fp[n:], wide[n:]
            if not len(k):
                continue
            passing = None
            other = np.flatnonzero((k != k[-1]) | (key != key[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from solve(k[:last], key[:last], fp[:last], wide[:last])
            k, key, fp, wide = k[last:], key[last:], fp[last:], wide[last:]
            if most is not None and len(k) > most:
                passing = (k[0], key[0])
                yield from out(fp, None, k[0])
                k, key, fp, wide = k[:0], key[:0], fp[:0], wide[:0]
        if len(k):
            yield from solve(k, key, fp, wide)

    return keyed.mapInArrow(run, "a long, b long, k int")


def paired(keyed: DataFrame, most: int) -> DataFrame:
    """keyed: (k, key, fp, wide). Buckets of over ``most`` rows become one bucket for each pair of their chunks of about half as many rows.

    Any two rows of a bucket meet in one of the new ones, so that walking these joins what walking it would.
    """
    half = max(1, most // 2)
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    sizes = common.materialize(sizes.select("k", "key", F.ceil(F.col("n") / half).cast("int").alias("chunks")), "sizes")
    if sizes.isEmpty():
        return keyed
    cut = keyed.join(common.small(sizes), ["k", "key"], "left").withColumn("own", F.expr("cast(pmod(xxhash64(fp, wide), chunks) as int)"))
    others = F.expr("if(chunks is null, array(key), transform(filter(sequence(0, chunks - 1), x -> x <> own), x -> xxhash64(key, least(x, own), greatest(x, own))))")
    return cut.select("k", F.explode(others).alias("key"), "fp", "wide")


def similar(prints: DataFrame, bucket: int = BUCKET, most: int = WALK, distance: int = FAR) -> DataFrame:
    """prints: (fp, wide, blocks). Links (a, b) between the fp of rows whose wide fingerprints are within distance."""
    rows = common.materialize(prints.select("fp", "wide", "blocks").distinct(), "wide")
    ordered = lambda x: x.repartition("k", "key").sortWithinPartitions("k", "key")
    keyed = rows.select("fp", "wide", F.posexplode("blocks").alias("k", "key")).where("key is not null").select("k", "key", "fp", "wide")
    first = common.materialize(_sample_links(ordered(keyed), bucket, distance), "similar")
    found, large = first.where("k is null").select("a", "b"), first.where("k is not null")
    if not large.isEmpty():
        again = large.select(F.col("a").alias("fp"), "k").distinct().join(rows, "fp").select("k", F.expr("element_at(blocks, k + 1)").alias("key"), "fp", "wide").where("key is not null")
        found = found.unionByName(_sample_links(ordered(paired(common.materialize(again, "large"), most)), None, distance).select("a", "b")).distinct()
    return found


def walk_sets(fp: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fp of rows whose sets have a similarity of FIFTHS or more, as all pairs would join them."""
    size = np.array([len(x) for x in sets])
    fp, sets, size = fp[size > 0], [x for x in sets if len(x)], size[size > 0]
    near, far = [fp[:0]], [fp[:0]]
    if len(fp) > 1:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        begin = np.cumsum(size) - size
        has = np.zeros(codes.max() + 1, dtype=bool)
        rest, queue = np.arange(len(fp)), []
        while len(rest):
            if not queue:
                queue.append(rest[0])
                rest = rest[1:]
                continue
            x = queue.pop()
            own = codes[begin[x] : begin[x] + size[x]]
            has[own] = True
            could = rest[(5 * np.minimum(size[rest], size[x]) >= FIFTHS * np.maximum(size[rest], size[x]))]
            both = np.array([np.count_nonzero(has[codes[begin[r] : begin[r] + size[r]]]) for r in could], dtype=np.int64)
            has[own] = False
            new = could[5 * both >= FIFTHS * (size[could] + size[x] - both)]
            near.append(np.full(len(new), fp[x]))
            far.append(fp[new])
            queue.extend(new)
            rest = rest[~np.isin(rest, new)]
    a, b = np.concatenate(near), np.concatenate(far)
    return a[a != b], b[a != b]


def confirmed(names: DataFrame, prints: DataFrame, candidates: DataFrame, texts: int = TEXTS) -> DataFrame:
    """names: (text_hash, text); prints: (text_hash, fp). Links (a, b) of the fp of texts of a similarity of 0.8 or more, within the components of candidates."""

    @F.arrow_udf("binary")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_hashes(x).tobytes() for x in common.encoded(batch.to_pylist())], pa.binary())

    def run(rows: pa.Table) -> pa.Table:
        a, b = walk_sets(rows.column("fp").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()])
        return pa.table({"a": a, "b": b})

    loose = connect(candidates.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    members = common.materialize(prints.select("text_hash", "fp").distinct().join(loose.withColumnRenamed("node", "fp"), "fp"), "members")
    sets = names.select("text_hash", "text").join(common.small(members), "text_hash").select("root", "fp", "text_hash", hashes("text").alias("hashes"))
    sets = common.materialize(sets.dropDuplicates(["fp", "text_hash"]), "shingles")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / texts), F.ceil(F.sum(F.octet_length("hashes")) / BYTES), F.lit(1)).cast("int")
    sizes = common.materialize(sets.groupBy("root").agg(chunks.alias("chunks")), "sizes")
    cut = sets.join(common.small(sizes), "root").withColumn("own", F.expr("cast(pmod(xxhash64(text_hash), chunks) as int)"))
    pairs = F.expr("if(chunks = 1, array(0L), transform(filter(sequence(0, chunks - 1), x -> x <> own), x -> least(x, own) * 4294967296L + greatest(x, own)))")
    return cut.select("root", F.explode(pairs).alias("part"), "fp", "hashes").groupBy("root", "part").applyInArrow(run, "a long, b long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct ``fp``. Distinct links (a > b) in the shared folder."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)])
    keyed = prints.select("fp", F.explode(keys).alias("x")).select("x.k", "x.key", "fp").repartition("k", "key").sortWithinPartitions("k", "key")
    first = common.materialize(_bucket_links(keyed, MASKS, bucket), "links")
    found, large = first.where("k is null").select("a", "b"), first.where("k is not null")
    if not large.isEmpty():
        finer = F.element_at(F.lit([[_signed(m) for m in x] for x in FINER]), F.col("k") + 1)
        again = large.select(F.col("a").alias("fp"), F.posexplode(finer).alias("p", "mask"), "k").select((F.col("k") * 100 + F.col("p")).alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        found = found.unionByName(_bucket_links(again.repartition("k", "key").sortWithinPartitions("k", "key"), None, None).select("a", "b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connect(edges: DataFrame) -> DataFrame:
    """Components of a graph, by alternating large and small stars; edges: (a, b), a > b.

    Returns (node, root), in the shared folder, for each node of an edge; root is the smallest node reachable.
    """
    was, now, seen = None, None, None
    edges = common.materialize(edges, "stars")
    while True:
        both = edges.union(edges.select("b", "a"))
        # Read from tables of their own, so that the join on a node of very many links is one that can be split.
        least = common.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = common.materialize(both.where("b > a").join(common.small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lesser = common.materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        star = large.join(common.small(lesser), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lesser).distinct()
        was, edges = edges, common.materialize(star, "stars")
        for x in (least, large, lesser):
            common.discard(x)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        common.discard(was)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def components(prints: DataFrame, bucket: int = BUCKET, more: DataFrame | None = None) -> DataFrame:
    """prints: (doc_id, fp, ...), materialized. Adds ``root``, the smallest fingerprint of the component, and ``component_id``.

    more: links (a, b) of fingerprints, in either order, beside those within three bits.
    """
    groups = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    found = links(groups.select("fp"), bucket)
    if more is not None:
        found = found.union(more.select(F.greatest("a", "b"), F.least("a", "b"))).distinct()
    rooted = common.materialize(connect(found), "roots")
    least = rooted.join(groups, rooted["node"] == groups["fp"]).groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = rooted.join(least, "root").select(F.col("node").alias("fp"), "root", "least_id")
    named = groups.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id"))
    # Read from a table of its own, so that a fingerprint of very many copies is a skewed join and nothing else.
    return prints.join(common.materialize(named, "named"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET, wide: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row of docs; wide: with the links of wide fingerprints too."""
    names = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    if not wide:
        return components(common.materialize(names.select("doc_id", "text_hash", fingerprint(F.col("text")).alias("fp")), "documents"), bucket)
    prints = common.materialize(names.select("doc_id", "text_hash", sketched(F.col("text")).alias("x")).select("doc_id", "text_hash", "x.*"), "documents")
    return components(prints.select("doc_id", "text_hash", "fp"), bucket, confirmed(names, prints, similar(prints, bucket, distance=LOOSE)))


def kept(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each component, by both kinds of links, the row of the smallest doc_id, with its own columns.

    Of rows with the same doc_id and text, the one that sorts first is kept.
    """
    found = common.materialize(near_duplicates(docs, wide=True), "groups")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("stay_id"), F.col("x.text_hash").alias("stay_hash"))
    stay_id, stay_hash, mark = common.fresh(docs, "stay_id", "stay_hash", "mark")
    stay = stay.select(F.col("stay_id").alias(stay_id), F.col("stay_hash").alias(stay_hash))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    on = marked["doc_id"].eqNullSafe(F.col(stay_id)) & (F.col(mark) == F.col(stay_hash))
    one = marked.join(stay, on, "left_semi")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash))
    if again.isEmpty():
        return one.select(*docs.columns)
    row = common.fresh(docs, "row")[0]
    single = one.join(again, on, "left_anti").select(*docs.columns)
    first = one.join(again, on, "left_semi").groupBy("doc_id", mark).agg(F.min(F.struct(*docs.columns)).alias(row))
    return single.union(first.select(f"{row}.*"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.texts(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
