"""Packing by power-of-two decomposition.

Each document's tokens (with the end mark) are cut into as many full sequences as they hold and then into
the binary digits of the rest, longest first. Every piece is a sequence of its own whose length is a power
of two, so no sequence crosses documents and none is padded; batches are drawn from buckets of equal lengths.

Tokens come from the ``tokenizers`` library. Byte-level BPE treats each word, number, run of stops and run of white space
by itself, so their ids are kept in a bounded cache by each Python worker. Texts of ASCII and Western letters are cut into these by the
pre-tokenizer's own rule, in which classes of characters are spelled out. Other texts are cut at spaces first; where white space of
three or more stands together those cuts would not be neutral, and the whole text goes through the library. (The
library alone encodes about 1 MB of texts a CPU second, Western ones with the same ids this way about ten.)

Edge cases: a null or empty text is the end mark alone, a sequence of length 1; repeated rows are packed
each; an empty table gives an empty result; of the input only the named columns are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH = 2048
END = 1
#: Units of text, and parts of them, whose ids a Python worker remembers in each of two generations, and characters of such: at about 200 bytes each.
CACHE, LONGEST = 300_000, 64
VOCABULARY = "byte_bpe_50k.json"


class _Cache(dict):
    """Remembers what make gives, but for keys of over LONGEST characters: texts without spaces would fill it with whole paragraphs.
    When it holds most entries they become the old generation, from which those still in use come back; entries that
    nothing asked for meanwhile are forgotten with the generation before."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, equal to the library's own for every text."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.tokens = self.tokenizer.model.tokenize
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # Cutting at a space is neutral unless white space stands on both sides of it, or it ends the text.
        self.uneven = re.compile(r"\s \s|\s $").search
        # Western words, stops and single line ends are cut here as the library would, only faster.
        word, stop = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?]+"
        self.simple = re.compile(f"{word}(?:{stop})?(?:\n{word}(?:{stop})?)*").fullmatch
        self.parts = re.compile(f"{word}|{stop}|\n").findall
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(rest)}
        # The rule of byte-level pre-tokenizers for characters of which each is in the same class here as there.
        letter = "A-Za-zÀ-ÖØ-öø-ÿ"
        self.western = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
        self.runs = re.compile(rf" ?[{letter}]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\s{letter}0-9]+|\s+(?!\S)|\s+").findall
        self.mapped = {b: self.bytes.get(b, chr(b)) for b in range(256)}
        self.cut = _Cache(self.run, CACHE)
        self.units, self.pieces = _Cache(self.unit, CACHE), _Cache(self.piece, CACHE)

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, text: str) -> bytes:
        return self.piece(text.encode().decode("latin-1").translate(self.mapped))

    def piece(self, text: str) -> bytes:
        return array("I", [t.id for t in self.tokens(text)]).tobytes()

    def unit(self, text: str) -> bytes:
        """text: what follows a space, up to the next."""
        if text.isascii() and text.isalpha():
            return self.pieces["Ġ" + text]
        if self.simple(text):
            first, *rest = self.parts(text) if text.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes) for p in self.parts(text)]
            return b"".join([self.pieces["Ġ" + first], *[self.pieces["Ċ" if p == "\n" else p] for p in rest]])
        if any(m in text for m in self.marks):
            return self.plain(" " + text)
        return b"".join([self.pieces[p] for p, _ in self.cuts(" " + text)])

    def encode(self, text: str) -> bytes:
        if self.western(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.cut.__getitem__, self.runs(text)))
        if self.uneven(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.units.__getitem__, rest))


def encoder(vocabulary: str) -> Encoder:
    """This process's encoder. vocabulary: a path, or the name of a public vocabulary file."""
    import os
    import sys
    import types

    kept = sys.modules.setdefault("_tidemark_encoders", types.ModuleType("_tidemark_encoders")).__dict__
    if vocabulary not in kept:
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        kept[vocabulary] = Encoder(path)
    return kept[vocabulary]


def pieces(n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For token counts n: the index of the document, the start and the length of each piece, in order."""
    full = n // length
    digits = np.arange(length.bit_length() - 2, -1, -1)
    set_ = ((n % length)[:, None] >> digits) & 1
    count = full + set_.sum(axis=1)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.full(len(doc), length, dtype=np.int64)
    size[nth >= full[doc]] = (1 << np.broadcast_to(digits, set_.shape))[set_ == 1]
    ends = np.cumsum(size)
    start = ends - size - np.repeat((ends - size)[np.flatnonzero(nth == 0)], count)
    return doc, start, size


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece, which is one sequence: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket).

    ids: the piece's tokens, little-endian unsigned 32-bit. bucket: the power of two, to batch equal lengths by.
    sequence_id numbers the sequences; it is unique, and the same again when a lost task is run again.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        mark = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(0, len(batch), 512):
                parts = [encode(x) + mark if x else mark for x in texts[i : i + 512].to_pylist()]
                n = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                if n.sum() > 400_000_000:  # offsets of a batch are 32-bit: documents of a gigabyte go one at a time
                    groups = [[j] for j in range(len(parts))]
                else:
                    groups = [list(range(len(parts)))]
                for g in groups:
                    doc, start, size = pieces(n[g], length)
                    data = pa.py_buffer(b"".join(parts[j] for j in g))
                    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [ids[i : i + 512].take(pa.array(np.array(g)[doc])), pa.array(start), pa.array(size), pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, data]), pa.array(n[g][doc])],
                        ["doc_id", "start", "length", "ids", "doc_tokens"],
                    )

    out = narrow.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return out.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def packed(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: the sequences, with the checksum of their ids in place of the ids."""
    out = pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.texts(spark, sf_dir, "documents").select("doc_id", "text"))
