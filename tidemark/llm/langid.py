"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of labelled texts. Case is folded, and
ASCII characters but letters and spaces are left out, of dictionaries and texts alike. A text is cut into
blocks, each block is compressed with each language's dictionary, and the language whose sizes sum to
the least wins. The margin is what the runner-up needs more, in bits a byte of text; narrow margins
are rejected.

Learning reads a bounded sample: distinct labelled texts are drawn by hash, SAMPLE_ROWS for each of the LANGS languages that have
most of them, of which whole texts go into a dictionary while they fit DICT_BYTES. Of a language that has only longer texts
it is made of the beginning of one. So the model is at most DICT_BYTES for each language,
whatever the size of the corpus and however often a text is repeated in it.

Edge cases: a null text or one without a letter is ``und`` with score and margin 0 and counts as
rejected; without any labelled row every text is ``und``; ties go to the language first by code point;
repeated rows get equal answers; extra columns are carried along unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled texts drawn for each language, and languages, at most: the bounds of the sample that dictionaries are made of.
SAMPLE_ROWS, LANGS = 256, 256
#: Largest dictionary, in bytes.
DICT_BYTES = 98_304
#: Texts are compressed in blocks of as many bytes, so that a long text can't become its own dictionary.
BLOCK = 4_096
#: Least margin, in bits a byte, of an answer that isn't rejected.
MARGIN = 0.02
#: A lazy search with short matches tells languages better than any preset of like speed: 99.1 % of held-out
#: texts at 7 MB a second for four languages, where level 3 has 97.7 % at the same speed (sf0.1).
SEARCH = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 1, "min_match": 4, "target_length": 8}
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and c != 32)
SCHEMA = "struct<lang:string,score:double,margin:double,rejected:boolean>"


def folded(text: str) -> bytes:
    return text.lower().replace("\n", " ").encode().translate(None, _NOT_LETTERS)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows, with at least one letter in a text. A language's name is 64 characters at most."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & (F.length("lang") <= 64) & F.col("text").rlike(r"\p{L}"))
    # Texts are told apart by hash, all copies being one, before anything is drawn: so no copies can fill the sample.
    texts = common.materialize(rows.select("lang", F.xxhash64("text").alias("place")).distinct(), "texts")
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return {}
    # Every text of a rare language, a thin slice by hash of a common one: the sample's size is the same at any input size.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * sample_rows / n))])
    first = Window.partitionBy("lang").orderBy("place")
    thin = texts.where(F.col("place").cast("double") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")])
    drawn = common.materialize(thin.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).select(F.col("lang").alias("of"), F.col("place").alias("at")), "drawn")
    # LANGS * SAMPLE_ROWS texts of DICT_BYTES characters come to the driver at most, one after the other.
    on = (rows["lang"] == drawn["of"]) & (F.xxhash64("text") == drawn["at"])
    whole = F.min(F.octet_length("text") < dict_bytes).alias("whole")
    found = rows.join(F.broadcast(drawn), on).groupBy("of", "at").agg(F.min(F.substring("text", 1, dict_bytes)).alias("text"), whole)
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    room, instead = dict.fromkeys(counts, dict_bytes), {}
    for r in found.orderBy("of", "at").toLocalIterator():
        x = folded(r["text"]) + b" "
        if not r["whole"]:
            instead.setdefault(r["of"], x[:dict_bytes])
        elif len(x) <= room[r["of"]]:
            out[r["of"]].append(x)
            room[r["of"]] -= len(x)
    return {k: b"".join(v) or instead[k] for k, v in sorted(out.items()) if v or k in instead}


def identify(text: Column, model: dict[str, bytes], margin: float = MARGIN) -> Column:
    """A struct (lang, score, margin, rejected) for each text."""
    langs = list(model)

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex
        import zstandard

        letter = regex.compile(r"\p{L}")
        packers = []
        for k in langs:
            d = zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, **SEARCH)
            d.precompute_compress(compression_params=p)
            packers.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
        for texts in batches:
            out = []
            for x in texts.to_pylist():
                if not langs or x is None or not letter.search(x):
                    out.append(("und", 0.0, 0.0, True))
                    continue
                b = folded(x)
                sizes = [0] * len(packers)
                for i in range(0, len(b), BLOCK):
                    block = b[i : i + BLOCK]
                    for j, pack in enumerate(packers):
                        sizes[j] += len(pack(block))
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = [s for j, s in enumerate(sizes) if j != best]
                more = 8.0 * (min(rest, default=len(b)) - sizes[best]) / max(1, len(b))
                # Bits saved in all, tempered by the square root of the length, as evidence in a softmax.
                score = 1.0 / sum(math.exp(min(0.0, (sizes[best] - s) * 4.0 / math.sqrt(len(b) + 1))) for s in sizes) if len(sizes) > 1 else 1.0
                out.append((langs[best], score, more, more < margin))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], ["lang", "score", "margin", "rejected"]
            )

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def kept(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents whose language is told with a margin, with their own columns."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    (name,) = common.fresh(docs, "language")
    return docs.withColumn(name, identify(F.col("text"), model)).where(~F.col(name)["rejected"]).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model).alias("x"))
    return out.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.margin").alias("margin"), F.col("x.rejected").alias("rejected"))
