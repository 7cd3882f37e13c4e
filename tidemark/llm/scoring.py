"""Language-model scoring by cross-entropy difference.

Two n-gram models share one vocabulary, order and smoothing: one of a target text collection, one of all other
documents as background. The score of a document is its loss a token under the target model less that under the
background model; low scores are like the target. Every text is counted; nothing is hashed into fewer cells, pruned or sampled.

Two token streams are modelled. ``difference`` is that of bytes: UTF-8 in SYMBOLS classes that keep a-z apart, and fold
capitals, digits, punctuation, and bytes of other scripts by lead and low bits; order ORDER, interpolated Witten-Bell
smoothing. That is a dense table of SYMBOLS ** ORDER cells.

``word_difference`` is that of words (runs of anything but ASCII white space, as they stand, and an end after the last
one), each after the one before it: Dirichlet smoothing of strength MU towards single words, and those by one more each. Its
vocabulary and pairs grow with the corpus. A document's own counts are left out of the model that holds them, so
that documents of the target are scored like held-out ones, and pairs that occur nowhere else count as unseen.

Pairs of words are counted in one exchange and answered in a second. A chunk of texts asks for each distinct pair of
its own once, as 48 bits of its hash below the word's hash, packed into one row for each part of the vocabulary; the part
sums up all chunks' counts and sends each chunk its pairs' totals, and the chunk's documents are scored where those
meet. So a pair that is in every document is one entry a chunk. Parts are dealt by the hash of the word; words of more than
a HOT-th of the corpus (fewer than HOT of them, whose totals every task knows) are spread by the hash of the pair.

Edge cases: a null or empty text has no tokens, losses and differences 0 (a blank one no words); a document with several labels belongs to the
target only if every label says so; repeated rows count each and score alike; an empty table gives an empty result; without a
target, or where all is target, the one model stands for both and differences are 0; a text longer than CHUNK is
counted in pieces, and what is held of it at once besides itself is about eight bytes a word and pair; extra columns are never read.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

SYMBOLS, ORDER = 48, 4
CELLS = SYMBOLS**ORDER
#: Bytes of text whose words, and whose n-grams of bytes, are held at once.
CHUNK, PIECE = 4 << 20, 1 << 20
#: Bytes of text whose n-grams a task sums up in cells of 32 bits.
MOST = (1 << 32) - 1
#: Words of prior mass after each word.
MU = 50.0
#: Words of over this share of the corpus are spread over parts by pair.
HOT = 4_096
#: Tokens of a part of the vocabulary, about.
PART = 1 << 20


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for group, bytes_ in enumerate((b" ", b"\n", b"0123456789", b".", b",", b"'\"`-()[]{}", b"!?:;", b"#*$%&|<>@^~_=+\\/"), start=0):
        table[list(bytes_)] = group
    table[[b for b in range(32) if b != 10] + [127]] = 1
    table[97:123] = 8 + np.arange(26)
    table[65:91] = 34
    for first, last, symbol in ((0xC0, 0xC3, 35), (0xC4, 0xCF, 36), (0xD0, 0xDF, 37), (0xE0, 0xEF, 38), (0xF0, 0xFF, 39)):
        table[first : last + 1] = symbol
    table[0x80:0xC0] = 40 + (np.arange(64) & 7)
    return table


CLASS = _classes()


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the n-gram that ends at each byte of the texts, and where each text begins. A text is preceded by line ends."""
    pad = b"\n" * (ORDER - 1)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    s = CLASS[np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)].astype(np.int32)
    cell = s.copy()
    for k in range(1, ORDER):
        cell[k:] += s[:-k] * np.int32(SYMBOLS**k)
    inside = np.ones(len(s), dtype=bool)
    begin = np.cumsum(n + len(pad)) - n - len(pad)
    for k in range(len(pad)):
        inside[begin + k] = False
    return cell[inside], np.cumsum(n) - n


def cells_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """What ngrams gives, for pieces of about PIECE bytes, and the number of the text with which a piece begins."""
    for i, j in chunks(map(len, texts), PIECE):
        if j > i + 1 or len(texts[i]) <= PIECE:
            yield *ngrams(texts[i:j]), i
        else:
            for k in range(0, len(texts[i]), PIECE):
                skip = min(k, ORDER - 1)
                yield ngrams([texts[i][k - skip : k + PIECE]])[0][skip:], np.zeros(1, np.int64), i


def chunks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes, each of about ``most`` bytes; a longer text stands alone."""
    i = j = size = 0
    for j, n in enumerate(sizes, start=1):
        if size and size + n > most:
            yield i, j - 1
            i, size = j - 1, 0
        size += n
    if i < j:
        yield i, j


def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows by chunks of about CHUNK bytes of texts, all of the target (True) or none. One chunk is copied out of its batch at a time."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for kind in (False, True):
            mine = np.flatnonzero(target == kind)
            for i, j in chunks(size[mine].tolist(), CHUNK):
                yield kind, batch.take(pa.array(mine[i:j]))
                common.give_back()


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by pieces of about CHUNK bytes."""
    i = 0
    while i < len(text):
        space = _SPACE.search(text, i + CHUNK) if i + CHUNK < len(text) else None
        j = space.start() if space else len(text)
        yield text[i:j].split()
        i = j


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
START, END = b"", b" "  # no words


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What counts sums up, of a task's texts."""
    from xxhash import xxh64_intdigest

    def out(kind, key, sums):
        fields = [pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(sums[0]), pa.array(sums[1])]
        yield from pa.Table.from_arrays(fields, names=["kind", "key", "background", "target"]).to_batches(max_chunksize=100_000)

    def cells():
        found = np.flatnonzero(total.any(axis=0))
        yield from out(0, found, total[:, found].astype(np.int64))

    total, held = None, 0
    for k, chunk in sides(batches):
        rows = _bytes(chunk)
        size = sum(map(len, rows))
        if total is None or held + size > MOST:
            if held:
                yield from cells()
            total, held = np.zeros((2, CELLS), dtype=np.uint32), 0
        held += size
        for cell, _, _ in cells_of(rows):
            found, times = np.unique(cell, return_counts=True)
            total[int(k), found] += times.astype(np.uint32)
        words: Counter = Counter()
        for piece in chain.from_iterable(map(split, rows)):
            words.update(piece)
        if words:
            words[END] = sum(1 for x in rows if x.strip())
            sums = np.zeros((2, len(words)), dtype=np.int64)
            sums[int(k)] = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            yield from out(1, np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64), sums)
        del rows, words
    if held:
        yield from cells()
    del total
    common.give_back()


def counts(texts: DataFrame) -> DataFrame:
    """texts: (text, target boolean). (kind, key, background, target), materialized: of kind 0 the n-grams of bytes by cell, of kind 1 the words
    by hash, each with its counts over texts that aren't the target's and over those that are."""
    made = texts.mapInArrow(counted, "kind byte, key long, background long, target long")
    return common.materialize(made.groupBy("kind", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "counts")


def losses(count: np.ndarray) -> np.ndarray:
    """-log2 of the smoothed probability of each cell's last symbol after its others; count: CELLS numbers.

    Witten-Bell: an order's estimate weighs n, that of the next lower one as many as there are distinct symbols
    after the context; below the lowest all symbols are alike.
    """
    c = count.reshape((SYMBOLS,) * ORDER).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        x = c.sum(axis=tuple(range(ORDER - k)))
        n, kinds = x.sum(axis=-1, keepdims=True), (x > 0).sum(axis=-1, keepdims=True)
        p = np.where(n > 0, (x + kinds * p) / np.maximum(n + kinds, 1), p)
    return -np.log2(p).ravel()


@dataclass
class Model:
    """cells: losses of each cell under the background's and the target's model. Of words: tokens, documents (both by model) and
    vocabulary, and hash and counts of the hot ones, by hash. A model without any text is the other one."""

    cells: np.ndarray
    tokens: tuple[int, int]
    documents: tuple[int, int]
    vocabulary: int
    hot: np.ndarray
    hot_counts: np.ndarray

    @property
    def models(self) -> tuple[int, int]:
        """Which counts stand for the background and for the target."""
        return (0 if self.tokens[0] else 1), (1 if self.tokens[1] else 0)


def learn(texts: DataFrame) -> Model:
    """texts: (text, target boolean)."""
    found = counts(texts)
    table = np.zeros((2, CELLS), dtype=np.int64)
    for batch in found.where("kind = 0").select("key", "background", "target").toArrow().to_batches():  # at most CELLS rows
        cell = batch.column("key").to_numpy()
        table[0, cell], table[1, cell] = batch.column("background").to_numpy(), batch.column("target").to_numpy()
    cells = np.stack([losses(table[k if table[k].any() else 1 - k]).astype(np.float32) for k in (0, 1)])
    words = found.where("kind = 1")
    end = _hash([END])[0]
    n, b, t, db, dt = words.agg(
        F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0)) for x in ("background", "target")], *[F.coalesce(F.sum(F.when(F.col("key") == int(end.view(np.int64)), F.col(x))), F.lit(0)) for x in ("background", "target")]
    ).first()
    # Fewer than HOT rows by their definition.
    rows = words.where((F.col("background") + F.col("target")) * HOT > b + t).select("key", "background", "target").collect()
    hot = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    known = np.array([[r["background"] for r in rows], [r["target"] for r in rows]], dtype=np.int64).reshape(2, -1)
    common.discard(found)
    return Model(cells, (b, t), (db, dt), n, hot[order], known[:, order])


def _hash(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64)


def _dump(*arrays: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    head = b"".join(struct.pack("<cI", x.dtype.char.encode(), len(x)) for x in arrays)
    return ZstdCompressor(level=1).compress(struct.pack("<B", len(arrays)) + head + b"".join(x.tobytes() for x in arrays))


def _load(data: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    data = ZstdDecompressor().decompress(data)
    at, out = 1 + 5 * data[0], []
    for k in range(data[0]):
        kind, n = struct.unpack_from("<cI", data, 1 + 5 * k)
        out.append(np.frombuffer(data, dtype=kind.decode(), count=n, offset=at))
        at += out[-1].nbytes
    return out


def _low(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of hashes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].ravel()


def _long(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), dtype=np.uint8)
    out[:, :width] = x.reshape(-1, width)
    return out.view("<u8").ravel()


def _narrow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those that don't fit one."""
    return np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype(np.int64)


def _wide(narrow: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = narrow.astype(np.int64)
    out[out == 255] = rest
    return out


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n numbers, none of them empty."""
    return np.add.reduceat(x, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def questions(texts: list[bytes], hot: np.ndarray, parts: int) -> tuple[np.ndarray, bytes, Iterator[tuple[int, bytes]]]:
    """The words of each text; what the answers are to be put together with; and for each part what is asked there.

    Occurrences (a pair in a text) are in the order of part, word, pair, text, in which the answers will be.
    """
    ids, n = {START: 0, END: 1}, []

    def stream():
        for t in texts:
            k = 0
            for piece in split(t):
                k += len(piece)
                yield from (ids.setdefault(w, len(ids)) for w in piece)
            n.append(k)

    # Numbers of words and texts and counts in one chunk fit 32 bits, as its bytes do.
    word = np.fromiter(stream(), dtype=np.int32)
    n = np.array(n, dtype=np.int64)
    some = n > 0
    word = np.insert(word, np.cumsum(n)[some], 1)
    size = n + some
    wide, high = len(ids), max(1, len(texts))
    key = word * np.int64(wide)
    key[1:] += word[:-1]
    first = (np.cumsum(size) - size)[some]
    key[first] = word[first] * np.int64(wide)
    key *= high
    key += np.repeat(np.arange(len(n), dtype=np.int32), size)
    del word
    key.sort()
    at = _runs(key)
    key, times = key[at], np.diff(at, append=len(key)).astype(np.int32)
    text = (key % high).astype(np.int32)
    key //= high
    before, word = (key % wide).astype(np.int32), (key // wide).astype(np.int32)
    del key, at
    own = np.unique(word * np.int64(high) + text, return_inverse=True)[1].astype(np.int32)
    own = np.bincount(own, weights=times)[own].astype(np.int32)
    hashes = _hash(ids)
    ids.clear()
    pair = hashes[before]
    pair *= np.uint64(0x9E3779B97F4A7C15)
    pair ^= hashes[word]
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(29)
    part = (np.where(np.isin(hashes, hot)[word], pair, hashes[word]) >> np.uint64(16)) % np.uint64(parts)
    part = part.astype(np.int32)
    order = np.argsort(part, kind="stable").astype(np.int32)
    text, before, word, times, own, pair, part = text[order], before[order], word[order], times[order], own[order], pair[order], part[order]
    del order
    pairs, words = _runs(part, word, before), _runs(part, word)
    pair_n, word_pairs = np.diff([*pairs, len(word)]), np.diff([*np.searchsorted(pairs, words), len(pairs)])
    meta = _dump((text & 255).astype(np.uint8), (text >> 8).astype(np.uint8), *_narrow(times), *_narrow(own), *_narrow(pair_n), *_narrow(word_pairs), (word[words] == 1).astype(np.uint8))

    def rows():
        asked = _sums(times.astype(np.int64), pair_n)
        first = np.append(_runs(part), len(part)) if len(part) else np.zeros(1, np.int64)
        for a, b in zip(first, first[1:], strict=False):
            p, q = np.searchsorted(pairs, [a, b])
            w, x = np.searchsorted(words, [a, b])
            yield int(part[a]), _dump(_low(hashes[word[words[w:x]]], 6), *_narrow(word_pairs[w:x]), _low(pair[pairs[p:q]], 5), *_narrow(asked[p:q]))

    return n, meta, rows()


def answers(asked: list[bytes], target: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> list[bytes]:
    """All that is asked in a part, each by texts of the target or not: counts of each pair and word by model."""
    if not asked:
        return []
    rows = [_load(x) for x in asked]
    words = _long(np.concatenate([r[0] for r in rows]), 6)
    word_pairs = np.concatenate([_wide(r[1], r[2]) for r in rows])
    low = _long(np.concatenate([r[3] for r in rows]), 5)
    hot = hot & np.uint64((1 << 48) - 1)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[:, order]
    times = np.concatenate([_wide(r[4], r[5]) for r in rows])
    n_pairs, n_words = np.array([len(r[4]) for r in rows]), np.array([len(r[1]) for r in rows])
    del rows
    known, word = np.unique(words, return_inverse=True)
    of = np.repeat(word, word_pairs)
    low |= of.astype(np.uint64) << np.uint64(40)
    key, pair = np.unique(low, return_inverse=True)
    n = len(key)
    del low, key
    to = np.repeat(target, n_pairs)
    two, one = [], []
    for k in (False, True):
        weights = np.where(to == k, times, 0).astype(np.float64)
        two.append(np.bincount(pair, weights=weights, minlength=n).astype(np.int64))
        one.append(np.bincount(of, weights=weights, minlength=len(known)).astype(np.int64))
    del of, to, times, weights
    if len(hot):
        at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
        for k in (0, 1):
            one[k] = np.where(hot[at] == known, hot_counts[k, at], one[k])
    ends, edges = np.cumsum(n_pairs), np.cumsum(n_words)
    return [
        _dump(*_narrow(two[0][pair[b - n : b]]), *_narrow(two[1][pair[b - n : b]]), *_narrow(one[0][word[e - m : e]]), *_narrow(one[1][word[e - m : e]]))
        for b, n, e, m in zip(ends, n_pairs, edges, n_words, strict=True)
    ]


def word_sums(meta: bytes, replies: list[bytes], texts: int, target: bool, model: Model, mu: float) -> np.ndarray:
    """The losses of each text of a chunk in bits, summed over its words and its end: under the background's model and under the target's."""
    low, high, t0, t1, o0, o1, p0, p1, w0, w1, end = _load(meta)
    text = low + 256 * high.astype(np.int64)
    times, own, pair_n, word_pairs = _wide(t0, t1), _wide(o0, o1), _wide(p0, p1), _wide(w0, w1)
    rows = [_load(x) for x in replies]
    get = lambda k: np.concatenate([_wide(r[k], r[k + 1]) for r in rows]) if rows else np.zeros(0, np.int64)
    by_pair = np.repeat(np.arange(len(pair_n)), pair_n)
    by_word = np.repeat(np.arange(len(word_pairs)), word_pairs)[by_pair]
    last = end[by_word] == 1
    out = np.zeros((2, texts))
    for k, m in enumerate(model.models):
        held = int(m == target)  # the model that holds these texts is asked without each one's own
        two = get(2 * m)[by_pair] - held * times
        one = get(4 + 2 * m)[by_word] - held * own
        single = (one + 1) / (model.tokens[m] + model.vocabulary)
        loss = -np.log2(two + mu * single) + np.where(last, 0.0, np.log2(one + mu))
        out[k] = np.bincount(text, weights=times * loss, minlength=texts)
        out[k] += np.where(np.bincount(text, minlength=texts) > 0, np.log2(model.documents[m] - held + mu), 0.0)
    return out


SCORES = ("n_tokens", "target_loss", "background_loss", "difference", "n_words", "word_target_loss", "word_background_loss", "word_difference")


def scored(texts: DataFrame, model: Model, mu: float = MU) -> DataFrame:
    """texts: (doc_id long, text, target boolean), the rows of a task in the same order whenever it runs. (doc_id, SCORES...) for each row."""
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(model.tokens) // PART))
    cells = spark.sparkContext.broadcast(model.cells)
    model = Model(np.zeros((2, 0)), model.tokens, model.documents, model.vocabulary, model.hot, model.hot_counts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chunk = cells.value, TaskContext.get().partitionId() << 32
        for kind, piece in sides(batches):
            rows, own = _bytes(piece), piece.column("doc_id").to_pylist()
            size, sums = np.array([len(x) for x in rows], dtype=np.int64), np.zeros((2, len(rows)))
            for cell, begin, at in cells_of(rows):
                some = np.flatnonzero(size[at : at + len(begin)])
                for k in (0, 1) if len(some) else ():
                    sums[k, at + some] += np.add.reduceat(loss[k][cell], begin[some], dtype=np.float64)
            n, meta, asked = questions(rows, model.hot, parts)
            del rows
            known = np.array([x is not None for x in own], dtype=np.uint8)
            own = np.array([x or 0 for x in own], dtype=np.int64)
            whole = _dump(own, known, size, n, sums[0], sums[1])
            out = [(chunk % parts, -1, struct.pack("<I", len(whole)) + whole + meta), *((p, p, x) for p, x in asked)]
            del asked
            yield from pa.Table.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([kind] * len(out)), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                names=["part", "chunk", "target", "place", "data"],
            ).to_batches(max_chunksize=1_000)
            del out
            chunk += 1

    def answer(rows: pa.Table) -> pa.Table:
        asked = rows.filter(pc.greater_equal(rows["place"], 0))
        said = answers(asked["data"].to_pylist(), asked["target"].to_numpy(), model.hot, model.hot_counts)
        common.give_back()
        replies = asked.select(["chunk", "target", "place"]).append_column("data", pa.array(said, pa.binary()))
        return pa.concat_tables([rows.filter(pc.less(rows["place"], 0)).select(["chunk", "target", "place", "data"]), replies.cast(rows.select(["chunk", "target", "place", "data"]).schema)])

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        data = rows["data"].to_pylist()
        (n,) = struct.unpack_from("<I", data[0])
        ids, known, size, words, background, target = _load(data[0][4 : 4 + n])
        sums = word_sums(data[0][4 + n :], data[1:], len(ids), rows["target"][0].as_py(), model, mu)
        tokens = np.maximum(size, 1)
        two = sums / np.where(words > 0, words + 1, 1)
        fields = [size, target / tokens, background / tokens, (target - background) / tokens, words, two[1], two[0], two[1] - two[0]]
        return pa.Table.from_arrays([pa.array(ids, mask=known == 0), *map(pa.array, fields)], names=["doc_id", *SCORES])

    asked = texts.mapInArrow(ask, "part int, chunk long, target boolean, place int, data binary")
    replied = asked.groupBy("part").applyInArrow(answer, "chunk long, target boolean, place int, data binary")
    kinds = ", ".join(f"{x} {'long' if x.startswith('n_') else 'double'}" for x in SCORES)
    return replied.groupBy("chunk").applyInArrow(finish, f"doc_id long, {kinds}")


def target_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label of theirs calls good and not toxic."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad"))
    return common.materialize(by.where("good = 1 and bad = 0").select(F.col("doc_id").alias("target_id")), "target")


def flagged(docs: DataFrame, ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, target) of docs, for learn and scored; ids: distinct ``target_id``, materialized."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    side = common.small(ids)
    out = d.join(side, d["doc_id"] == ids["target_id"], "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    # Rows of a scan come in the same order whenever a task runs again, those of a shuffled join need not.
    return out if side is not ids else out.sortWithinPartitions("doc_id", F.xxhash64("text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = flagged(common.texts(spark, sf_dir, "documents", ("doc_id", "text")), target_ids(common.table(spark, sf_dir, "labels")))
    return scored(texts, learn(texts))
