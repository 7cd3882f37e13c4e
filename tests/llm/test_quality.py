import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests import parity
from tests.llm import edge
from tidemark.llm import common, quality

SPACE = r"[\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def test_measures():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "中"]) for _ in range(r.randint(0, 60)))
        assert quality.measure(text.encode()) == brute(text), repr(text)
    assert quality.measure(edge.LONG.encode()) == brute(edge.LONG)


def test_query_and_sql(spark):
    assert parity.same(quality.op10(spark, parity.SF), quality.OP10_SQL) == 200


def test_edge_cases(spark, tmp_path):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    parity.same(quality.op10(spark, folder), quality.OP10_SQL, views={"documents": f"{folder}/documents.parquet/*.parquet"})
    assert [r["doc_id"] for r in quality.kept(edge.clashing(spark)).collect()] == []
    clean = (20, " ".join(f"w{i}" for i in range(60)), "en", "z", 9)
    out = quality.kept(edge.clashing(spark, [*edge.ROWS, clean, clean]))
    assert [r["doc_id"] for r in out.collect()] == [20, 20] and out.columns == edge.clashing(spark).columns
    assert quality.kept(edge.docs(spark, [])).count() == 0


def judged(spark, rows):
    return common.materialize(quality.judge_documents(edge.docs(spark, rows)), "test")


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(i, good, "en", f"h{i % 20}", 1) for i in range(400)]
    rows += [(1000 + i, bad if i < 36 else good, "en", "farm", 1) for i in range(40)]
    rows += [(2000, bad, "en", "once", 1), (3000, good, "en", None, 1)]
    out = {r["doc_id"]: r["host_bad"] for r in quality.host_filter(judged(spark, rows)).collect()}
    assert all(out[1000 + i] for i in range(40)) and not out[2000] and not out[3000] and not any(out[i] for i in range(400))
    rates = {r["host"]: r["rate"] for r in quality.host_rates(judged(spark, rows), "source", "fails").where("rule = 'short'").collect()}
    assert 0.8 < rates["farm"] < 0.9 and rates["once"] < 0.5 and rates["h0"] < 0.05


def planted(noisy):
    """A host with many failures of a rule, and a clean one of which a single document fails it."""
    fine = " ".join(f"w{i}" for i in range(60))
    odd = fine + " #####" * 4
    rows = [(i, fine, "en", "clean", 1) for i in range(3_000)] + [(9_000, odd, "en", "clean", 1)]
    return rows + [(10_000 + i, odd if i < noisy else fine, "en", "farm", 1) for i in range(1_000)]


def test_the_host_decides(spark, tmp_path):
    """The same text stays at a clean host and goes at one that often fails its rule; over one half all of the host goes."""
    folder = edge.save(spark, planted(80), tmp_path)
    views = {"documents": f"{folder}/documents.parquet/*.parquet"}
    parity.same(quality.op10(spark, folder), quality.OP10_SQL, views=views)
    out = {r["doc_id"]: r["kept"] for r in quality.op10(spark, folder).collect()}
    assert out[9_000] and not out[10_000] and out[10_500] and all(out[i] for i in range(3_000))
    folder = edge.save(spark, planted(800), tmp_path / "2")
    out = {r["doc_id"]: r["kept"] for r in quality.op10(spark, folder).collect()}
    assert out[9_000] and not any(out[10_000 + i] for i in range(1_000)) and all(out[i] for i in range(3_000))
    assert {r[0] for r in quality.kept(edge.docs(spark, planted(800))).select("source").distinct().collect()} == {"clean"}


def test_without_hosts_nothing_but_base_rules_rejects(spark):
    rows = [(i, t, "en", None, 1) for i, t in enumerate([" ".join(f"w{i}" for i in range(60)) + " ####" * 3, "short"])]
    assert [r["doc_id"] for r in quality.kept(edge.docs(spark, rows)).collect()] == [0]


def test_share_that_hosts_decide(spark):
    """Of the table's documents, those that only the host verdicts reject."""
    out = quality.op10(spark, "/root/testdata/sf0.01")
    n = out.where("not base_failed and not kept").count()
    assert n == 68 and out.where("host_bad").count() == 0


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{parity.SF}/labels.parquet")
    out = quality.op10(spark, parity.SF).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert out.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97
