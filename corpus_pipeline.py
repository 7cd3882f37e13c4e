"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of docs. ORACLE_SQL is None: the language stage compresses texts and the fingerprints are XXH64,
which SQL can't express, so tests hold run() against a brute-force version.

Edge cases, of every stage: a null text counts as empty, which the first stage rejects, and the others do without failing;
null ids, languages and sources are values of their own; of rows that repeat whole or share id and text, the third
stage keeps one; very long texts are worked on whole; an empty table gives an empty result; columns beside those
of documents are carried along up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, langid, mixing, neardup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and those that count for their host. A null source is held to the mean host."""
    return quality.kept(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; none where no row has a language to learn from."""
    return langid.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, null ids last."""
    return neardup.kept(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them; texts without a word aren't taken."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence; a null text is the end mark alone."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences made of all documents; what a stage returns is written to the shared folder and read again."""
    docs = common.texts(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
