import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from tidemark.llm import scoring


def symbols(text):
    return [int(scoring.CLASS[b]) for b in b"\n\n\n" + text.encode()]


def model(texts):
    """The probability of a symbol after a context, by the definition."""
    grams = [Counter() for _ in range(5)]
    for t in texts:
        s = symbols(t)
        for i in range(3, len(s)):
            for k in range(1, 5):
                grams[k][tuple(s[i - k + 1 : i + 1])] += 1

    def p(context, x):
        out = 1 / scoring.SYMBOLS
        for k in range(1, 5):
            c = tuple(context[len(context) - k + 1 :])
            after = {g[-1]: n for g, n in grams[k].items() if g[:-1] == c}
            if after:
                out = (after.get(x, 0) + len(after) * out) / (sum(after.values()) + len(after))
        return out

    return p


def loss(p, text):
    s = symbols(text)
    return [-math.log2(p(s[i - 3 : i], s[i])) for i in range(3, len(s))]


def test_by_definition(spark, tmp_path):
    texts = {1: "the cat sat on the mat.", 2: "THE DOG!! ran, 42 times", 3: "", 4: None, 5: "été le chat", 6: "the cat ran"}
    folder = edge.save(spark, [(i, t, "en", "s", 1) for i, t in texts.items()], tmp_path)
    edge.save(spark, [(1, 1, 0), (6, 1, 0), (2, 0, 0), (5, 1, 1), (6, 1, None), (None, 1, 0)], tmp_path, "doc_id long, quality int, toxic int", "labels")
    got = {r["doc_id"]: r for r in scoring.op3(spark, folder).collect()}
    background, target = model([t for i, t in texts.items() if t and i not in (1, 6)]), model([texts[1], texts[6]])
    for i, t in texts.items():
        a, b = loss(target, t or ""), loss(background, t or "")
        n = max(1, len(a))
        assert got[i]["n_tokens"] == len(a)
        assert abs(got[i]["target_loss"] - sum(a) / n) < 1e-4 and abs(got[i]["background_loss"] - sum(b) / n) < 1e-4
        assert abs(got[i]["difference"] - (sum(a) - sum(b)) / n) < 1e-4


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    c = np.zeros(scoring.CELLS)
    c[r.integers(0, scoring.CELLS, 5000)] = r.integers(1, 9, 5000)
    p = 2.0 ** -scoring.losses(c).reshape(-1, scoring.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


def area(low, high):
    """The share of pairs in which the first is less."""
    return sum(a < b for a in low for b in high) / len(low) / len(high)


def test_held_out_labels(spark):
    """Both models are learned without a quarter of the labels, on which they are judged."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = scoring.flagged(spark.read.parquet(f"{sf}/documents.parquet"), scoring.target_ids(labels.where("doc_id % 4 <> 2")))
    rows = scoring.scored(texts, scoring.learn(texts)).join(labels.where("doc_id % 4 = 2"), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert len(bad) >= 5
    assert area([r["difference"] for r in good], [r["difference"] for r in bad]) > 0.95
    assert area([r["word_difference"] for r in good], [r["word_difference"] for r in bad]) > 0.7  # 0.73


def test_edge_cases(spark, tmp_path):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    edge.save(spark, [], tmp_path, "doc_id long, quality int, toxic int", "labels")
    got = scoring.op3(spark, folder).collect()
    assert len(got) == len(edge.ROWS) and {r["difference"] for r in got} == {0.0} == {r["word_difference"] for r in got}
    assert next(r for r in got if r["doc_id"] == 5)["n_tokens"] == len(edge.LONG)
    edge.save(spark, [], tmp_path / "e")
    edge.save(spark, [], tmp_path / "e", "doc_id long, quality int, toxic int", "labels")
    assert scoring.op3(spark, str(tmp_path / "e")).count() == 0


def test_chunks_do_not_change_scores(monkeypatch):
    texts = [b"abc def", b"", b"x" * 50, b"hello"]
    whole, begin = scoring.ngrams(texts)
    pieces = [p for t in texts for p in scoring.split(t)]
    monkeypatch.setattr(scoring, "CHUNK", 8)
    monkeypatch.setattr(scoring, "PIECE", 8)
    parts = list(scoring.cells_of(texts))
    assert (np.concatenate([c for c, _, _ in parts]) == whole).all() and len(whole) == sum(map(len, texts))
    assert {i for _, _, i in parts} == {0, 2, 3} and sum(i == 2 for _, _, i in parts) == 7
    long = b" one  two three\nfour five " * 9
    assert [w for p in scoring.split(long) for w in p] == long.split() and sum(1 for _ in scoring.split(long)) > 9
    assert [w for p in pieces for w in p] == [b"abc", b"def", b"x" * 50, b"hello"]


def word_loss(rows, own, text, target, mu=scoring.MU):
    """Losses a word and end of text under both models by the definition; rows: (text, target). own: the index of the text's row."""
    vocabulary = len({w for t, _ in rows for w in t.split()} | {"END"})
    out = []
    for side in (False, True):
        pairs, words, docs = Counter(), Counter(), 0
        tokens = 0
        for k, (t, is_target) in enumerate(rows):
            w = t.split()
            if is_target != side or not w:
                continue
            tokens += len(w) + 1
            if k == own:
                continue
            docs += 1
            words.update([*w, "END"])
            pairs.update(zip(["START", *w], [*w, "END"], strict=True))
        words["START"] = docs
        w = text.split()
        loss = [-math.log2((pairs[a, b] + mu * (words[b] + 1) / (tokens + vocabulary)) / (words[a] + mu)) for a, b in zip(["START", *w], [*w, "END"], strict=True)]
        out.append(sum(loss) / len(loss) if w else 0.0)
    return out


def test_words_by_definition(spark, tmp_path, monkeypatch):
    """Every word counts as it stands, whatever its length and script, and a text isn't scored by its own counts."""
    texts = {1: "the cat sat on the mat.", 2: "THE DOG!! ran, 42 times", 3: "  ", 4: None, 5: "чёрный кот и белый кот", 6: "the cat ran", 7: "the cat ran", 8: "commendable commendation the cat", 9: "the cat " * 300}
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()] + [(7, texts[7], "en", "s", 1), (None, texts[1], "en", "s", 1)]
    folder = edge.save(spark, rows, tmp_path)
    edge.save(spark, [(1, 1, 0), (6, 1, 0), (5, 1, 0)], tmp_path, "doc_id long, quality int, toxic int", "labels")
    flags = [(r[1] or "", r[0] in (1, 5, 6)) for r in rows]
    for hot, part in ((4096, 1 << 20), (8, 40), (2, 10)):
        monkeypatch.setattr(scoring, "HOT", hot)
        monkeypatch.setattr(scoring, "PART", part)
        got = scoring.op3(spark, folder).collect()
        assert len(got) == len(rows)
        for r in got:
            k = next(i for i, x in enumerate(rows) if x[0] == r["doc_id"])
            b, t = word_loss(flags, k, flags[k][0], flags[k][1])
            assert r["n_words"] == len(flags[k][0].split())
            assert abs(r["word_target_loss"] - t) < 1e-6 and abs(r["word_background_loss"] - b) < 1e-6 and abs(r["word_difference"] - t + b) < 1e-6


def test_repeated_texts_stand_out(spark, tmp_path):
    """A text that the corpus has twice is likelier under the background than one it has once, in every part of it."""
    r = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in r.integers(0, 500, 80))
    once, twice = [text() for _ in range(20)], [text() for _ in range(20)]
    folder = edge.save(spark, [(i, t, "en", "s", 1) for i, t in enumerate(once + twice + twice)], tmp_path)
    edge.save(spark, [], tmp_path, "doc_id long, quality int, toxic int", "labels")
    got = {x["doc_id"]: x["word_background_loss"] for x in scoring.op3(spark, folder).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60))


def test_long_text(spark, tmp_path):
    """A text of more than CHUNK bytes is counted in pieces, whole."""
    text = "alpha beta gamma delta " * 500_000
    folder = edge.save(spark, [(1, text, "en", "s", 1), (2, "alpha beta", "en", "s", 1)], tmp_path)
    edge.save(spark, [(2, 1, 0)], tmp_path, "doc_id long, quality int, toxic int", "labels")
    got = {x["doc_id"]: x for x in scoring.op3(spark, folder).collect()}
    assert len(text) > scoring.CHUNK and got[1]["n_words"] == 2_000_000 and got[1]["n_tokens"] == len(text)


@pytest.mark.parametrize("step, most", [("counts", 90), ("scored", 130)])
def test_memory_of_a_task(spark, monkeypatch, step, most):
    """MB that a task holds at once beside its batch of 33 MB; two tasks share an executor with the JVM (138 and 179 MB before)."""
    found = []

    class Texts:
        sparkSession = spark

        def mapInArrow(self, f, schema):
            found.append(f)
            raise InterruptedError

    monkeypatch.setattr(scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    loss = np.ones((2, scoring.CELLS), np.float32)
    model = scoring.Model(loss, (1 << 25, 1 << 20), (1_000, 100), 9_000, np.zeros(0, np.uint64), np.zeros((2, 0), np.int64))
    with pytest.raises(InterruptedError):
        scoring.counts(Texts()) if step == "counts" else scoring.scored(Texts(), model)
    r = np.random.default_rng(3)
    texts = [" ".join(map("w{}".format, r.integers(0, 9_000, 600))) for _ in range(9_500)]
    batch = pa.record_batch({"doc_id": np.arange(len(texts)), "text": texts, "target": np.arange(len(texts)) % 10 == 0})
    assert 30e6 < batch.nbytes
    del texts
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in found[0](iter([batch])))
        assert rows > 0 and tracemalloc.get_traced_memory()[1] / 1e6 < most
    finally:
        tracemalloc.stop()


def test_cells_are_handed_on_before_they_are_full(monkeypatch):
    def sums():
        total = Counter()
        batches = [pa.record_batch({"text": ["the cat sat"] * 7 + [None, ""], "target": [k % 2 == 0 for k in range(9)]})] * 5
        rows = [r for x in scoring.counted(batches) for r in x.to_pylist()]
        for r in rows:
            total.update({(r["kind"], r["key"], k): r[k] for k in ("background", "target")})
        return len(rows), total

    few, whole = sums()
    monkeypatch.setattr(scoring, "MOST", 100)
    many, parts = sums()
    assert many > few and parts == whole
