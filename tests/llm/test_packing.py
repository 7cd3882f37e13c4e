import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests import parity
from tests.llm import edge
from tidemark.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_equals_the_library():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    some = ["a", "b", "Ab", "é", "Œ", " ", " ", " ", "\n", "\t", "1", ".", "'s", "'", "\xa0", "　", "<|endoftext|>", "\x1c", "\u0085", "中", "ß", "!"]
    for text in ["", " ", "  ", "a  ", " a", "don't we'll"] + ["".join(r.choice(some) for _ in range(r.randint(1, 16))) for _ in range(8000)]:
        assert encoder.encode(text) == ids(text), repr(text)
    western = [*"abXé10.,!?'\"-#& \n\t\r", "  ", " \n", "'ll", "'s", "'S", "don't", "ÿ", "x'", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(r.choice(western) for _ in range(r.randint(1, 14)))
        assert encoder.encode(text) == ids(text), repr(text)
    long = ["中文" * 5_000, "é" * 9_000 + " Œ" + "x" * 9_000, "a" * 9_000 + "." * 9_000, "Œ" * 300]
    for text in long:
        assert encoder.encode(text) == ids(text)
    assert max(map(len, [*encoder.units, *encoder.pieces, *encoder.cut])) <= packing.LONGEST  # what is remembered is bounded in bytes
    encoder.units.most = encoder.pieces.most = encoder.cut.most = 3
    for text in ["a b c d e f g a b c d e f g", "é è à é è à ü"] * 2:
        assert encoder.encode(text) == ids(text)


@pytest.mark.parametrize("length", [1, 8, 2048])
def test_pieces(length):
    n = np.array([1, 2, 7, 8, 9, 2047, 2048, 2049, 6000])
    doc, start, size = packing.pieces(n, length)
    for i, tokens in enumerate(n.tolist()):
        mine = size[doc == i].tolist()
        assert sum(mine) == tokens and start[doc == i].tolist() == np.cumsum([0, *mine[:-1]]).tolist()
        assert all(x & (x - 1) == 0 and x <= length for x in mine) and len(set(mine[tokens // length :])) == len(mine) - tokens // length


def check(rows, got):
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append(ids(text) + b"\1\0\0\0")
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    seen = Counter()
    for r in got:
        whole = want[r["doc_id"]][0]
        assert r["doc_tokens"] == len(whole) // 4 and r["length"] == 1 << r["bucket"]
        assert r["ids_crc32"] == zlib.crc32(whole[4 * r["start"] : 4 * (r["start"] + r["length"])])
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: sum(len(x) // 4 for x in v) for k, v in want.items()}


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{parity.SF}/documents.parquet").collect()]
    check(rows, packing.op6(spark, parity.SF).collect())


def test_edge_cases(spark, tmp_path):
    check(edge.ROWS, packing.op6(spark, edge.save(spark, edge.ROWS, tmp_path)).collect())
    assert packing.op6(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    assert packing.pack(edge.clashing(spark)).count() > 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(edge.docs(spark), length=100)
    out = packing.pack(edge.docs(spark), length=4).where("doc_id = 1").orderBy("start")
    whole = b"".join(bytes(r["ids"]) for r in out.collect())
    assert whole == ids(edge.ROWS[0][1]) + b"\1\0\0\0"
    assert out.agg(F.max("length")).first()[0] == 4
