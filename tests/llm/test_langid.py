import math
import zlib

from pyspark.sql import functions as F

from tests import parity
from tests.llm import edge
from tidemark.llm import langid


def test_held_out_accuracy(spark):
    out = langid.op9(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    rows = out.select("held_out", (F.col("lang") == F.col("lang_pred")).alias("ok"), "score", "doc_id").collect()
    test = [r["ok"] for r in rows if r["held_out"]]
    assert len(test) > 200 and sum(test) / len(test) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_learning_reads_no_held_out_row(spark, tmp_path):
    rows = [(i, f"word{i} " * 20, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", "s", 1) for i in range(60)]
    out = langid.op9(spark, edge.save(spark, rows, tmp_path))
    assert {r["lang_pred"] for r in out.collect()} == {"yy"}


def test_edge_cases(spark, tmp_path):
    out = {r["doc_id"]: r for r in langid.op9(spark, edge.save(spark, edge.ROWS, tmp_path)).collect()}
    assert len(out) == 10
    assert {i: out[i]["lang_pred"] for i in (2, 3, 4, 9)} == dict.fromkeys((2, 3, 4, 9), "und")
    assert all(r["lang_pred"] in ("en", "fr") for i, r in out.items() if i not in (2, 3, 4, 9))
    none = langid.op9(spark, edge.save(spark, [(1, "some text", None, "s", 1)], tmp_path / "n"))
    assert none.first()["lang_pred"] == "und"
    assert langid.op9(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    assert langid.kept(edge.clashing(spark)).columns == edge.clashing(spark).columns


def test_dictionaries_are_bounded(spark):
    rows = [(i, f"text number {i} of many", "en", "s", 1) for i in range(3000)] + [(5000, edge.LONG, "en", "s", 1), (5001, "ein Text", "de", "s", 1)]
    model = langid.learn(edge.docs(spark, rows), dict_bytes=1000)
    assert set(model) == {"en", "de"} and len(model["en"]) <= 1000 and model["de"] == b"ein text "
    assert model == langid.learn(edge.docs(spark, rows).repartition(7), dict_bytes=1000)


def test_copies_do_not_fill_the_sample(spark):
    """Of very many copies one counts, and a language with only long texts has a dictionary too."""
    rows = [(i, "the same again", "en", "s", 1) for i in range(3000)] + [(9000 + i, f"another english text with number {i}", "en", "s", 1) for i in range(40)]
    model = langid.learn(edge.docs(spark, [*rows, (1, "langer Text " * 500, "de", "s", 1)]), sample_rows=30, dict_bytes=2000)
    assert model["en"].count(b"the same again") <= 1 and model["en"].count(b"another english text") >= 20
    assert len(model["de"]) == 2000 and model["de"].startswith(b"langer text langer")


def test_answers_by_brute_force(spark):
    """Sizes of every block under every dictionary, the least sum, its margin and score, for all rows."""
    import regex
    import zstandard

    table = spark.read.parquet(f"{parity.SF}/documents.parquet")
    model = langid.learn(table.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.op9(spark, parity.SF).collect()}
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, window_log=18, chain_log=17, hash_log=17, search_log=1, min_match=4, target_length=8)
    for r in table.collect():
        text, out = r["text"], got[r["doc_id"]]
        if not regex.search(r"\p{L}", text or ""):
            assert (out["lang_pred"], out["score"]) == ("und", 0.0)
            continue
        plain = "".join(c for c in text.lower().replace("\n", " ") if ord(c) > 127 or c.isalpha() or c == " ").encode()
        sizes = {}
        for lang, words in model.items():
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(plain[i : i + 4096])) for i in range(0, len(plain), 4096))
        best = min(sizes, key=lambda k: (sizes[k], k))
        second = min(v for k, v in sizes.items() if k != best)
        assert out["lang_pred"] == best
        assert abs(out["margin"] - 8 * (second - sizes[best]) / max(1, len(plain))) < 1e-9 and out["rejected"] == (out["margin"] < 0.02)
        assert abs(out["score"] - 1 / sum(math.exp(-4 * (s - sizes[best]) / math.sqrt(len(plain) + 1)) for s in sizes.values())) < 1e-9
