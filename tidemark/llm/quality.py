"""Quality rules with host verdicts.

Each document is measured and held against rules. Failures are then summed by host and rule, and each rate is shrunk
towards the mean of all hosts by a beta prior whose strength is estimated from the hosts themselves (moments of the
beta-binomial). The shrunk rate is the prior probability that a document of the host is bad by that rule. A failed
rule is evidence of EVIDENCE to one, so a document that fails it goes where the posterior is over one half: a host that
all but never fails a rule gets the benefit of the doubt, others don't. A host whose shrunk rate of a rule is itself
over one half is rejected with all its documents, those that fail nothing too. These verdicts, one row a host, are
joined back to the documents; apart from the two base rules nothing else rejects a document.

Edge cases: a null text counts as empty and so fails ``short``; a null host is held to the mean of the known ones (to
the base rules alone if there are none) and is never rejected as a whole; repeated rows are each judged and each
counted; an empty table gives an empty result; columns of the input other than the text and the host are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A rule's failures over this share of a host's documents, after shrinking, reject the host.
HOST_LIMIT = 0.5
#: How much likelier a bad document fails a rule than a good one: with the limit of one half, rules count from a shrunk rate of 1 in 401 on.
EVIDENCE = 400
#: Bounds of the share of variance that lies between hosts; they bound the prior's strength to 4 .. 9,999 documents, so a lone failure condemns no host.
RHO = (0.0001, 0.2)


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    import numpy as np

    words = text.split()
    n = len(words)
    letters = sum(map(len, words))
    chars = len(text.decode()) - (len(text) - letters)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        if len(seen) < n:
            pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
            if len(pairs) > pairs.max() + 1:
                _, window, times = np.unique(pairs[:-1] * (pairs.max() + 1) + pairs[1:], return_inverse=True, return_counts=True)
                start = np.flatnonzero(times[window] > 1)
                inside = np.zeros(n, dtype=bool)
                for k in range(3):
                    inside[start + k] = True
                repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(text: Column) -> Column:
    """A struct of MEASURES (all long) for each text."""

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES).join(("struct<", ">")).replace(" long", ":long"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [measure(x) for x in common.encoded(texts.to_pylist())]
            columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))

    return run(text)


def rules(m: Column) -> dict[str, Column]:
    """True where a document fails the rule. The first two are the base rules."""
    return {
        "short": m["n_words"] < 50,
        "repetitive": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "odd_words": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"]),
    }


BASE = ("short", "repetitive")
RULES = ("short", "repetitive", "symbols", "repeated_lines", "odd_words")


def judge_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct of measures and one of rule failures beside its own columns.

    The two columns are named ``measures`` and ``fails``, with underscores appended where docs has such names.
    """
    m, f = common.fresh(docs, "measures", "fails")
    out = docs.withColumn(m, measured(F.col(text)))
    return out.withColumn(f, F.struct(*[x.alias(k) for k, x in rules(F.col(m)).items()]))


def host_rates(judged: DataFrame, host: str, fails: str) -> DataFrame:
    """One row for each host and rule: documents n, failures k, the shrunk rate and the prior (mean, strength)."""
    known = judged.where(F.col(host).isNotNull())
    by_host = known.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(fails)[r].cast("long")).alias(r) for r in RULES]
    )
    tall = by_host.select("host", F.col("n").cast("double").alias("n"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("k")) for r in RULES])).alias("x")).select("host", "n", "x.rule", "x.k")
    total = tall.groupBy("rule").agg(
        F.count(F.lit(1)).cast("double").alias("h"), F.sum("n").alias("nn"), F.sum("k").alias("kk"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"),
    )
    mean = F.col("kk") / F.col("nn")
    between = F.col("k2") - F.col("kk") * F.col("kk") / F.col("nn")
    room = F.col("nn") - F.col("n2") / F.col("nn") - (F.col("h") - 1)
    rho = F.when((mean > 0) & (mean < 1) & (room > 0), (between / (mean * (1 - mean)) - (F.col("h") - 1)) / room).otherwise(F.lit(RHO[1]))
    prior = total.select("rule", mean.alias("mean"), (1 / F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), rho)) - 1).alias("strength"))
    return tall.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("k") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))


def verdicts(judged: DataFrame, host: str, fails: str, limit: float = HOST_LIMIT, evidence: float = EVIDENCE) -> DataFrame:
    """One row for each host in the shared folder: ``host``, whether it is rejected (``bad``), and the rules that count for it (``strict``).

    The row of the null host has the verdicts of the mean rates.
    """
    rates = common.materialize(host_rates(judged, host, fails).select("host", "rule", "rate", "mean"), "rates")
    mean = rates.groupBy("rule").agg(F.max("mean").alias("rate"))
    every = rates.select("host", "rule", "rate").unionByName(mean.select(F.lit(None).cast(rates.schema["host"].dataType).alias("host"), "rule", "rate"))
    counts = F.col("rate") * evidence > 1 - F.col("rate")
    bad = F.col("host").isNotNull() & F.max(F.col("rate") > limit)
    out = every.groupBy("host").agg(bad.alias("bad"), F.collect_set(F.when(counts, F.col("rule"))).alias("strict"))  # at most as many as there are rules
    return common.materialize(out, "hosts")


def host_filter(judged: DataFrame, fails: str = "fails", host: str = "source", limit: float = HOST_LIMIT, evidence: float = EVIDENCE) -> DataFrame:
    """judged, which is materialized, with booleans ``host_bad`` and ``passes``, named with underscores appended where it has such columns.

    ``passes``: the host isn't rejected, and of the rules that count for it the document fails none, nor a base rule.
    """
    flag, ok, name, strict = common.fresh(judged, "host_bad", "passes", "verdict_host", "strict")
    v = verdicts(judged, host, fails, limit, evidence).select(F.col("host").alias(name), F.col("bad").alias(flag), F.col("strict").alias(strict))
    joined = judged.join(common.small(v), F.col(host).eqNullSafe(F.col(name)), "left")
    passes = ~F.coalesce(F.col(flag), F.lit(False))
    for r in RULES:
        counts = F.lit(True) if r in BASE else F.coalesce(F.array_contains(strict, r), F.lit(False))
        passes &= ~(F.col(fails)[r] & counts)
    return joined.withColumn(ok, passes).withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop(name, strict)


def kept(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that pass, with their own columns."""
    _, f = common.fresh(docs, "measures", "fails")
    judged = common.materialize(judge_documents(docs), "judged")  # texts included, so that they are measured once
    ok = common.fresh(judged, "host_bad", "passes")[1]
    return host_filter(judged, f).where(F.col(ok)).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = common.materialize(judge_documents(docs).drop("text"), "judged")
    m, f = F.col("measures"), F.col("fails")
    failed = f["short"] | f["repetitive"]
    return host_filter(judged).select("doc_id", *[m[x].alias(x) for x in MEASURES[:5]], failed.alias("base_failed"), F.col("passes").alias("kept"), "host_bad")


OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, source from documents),
 w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
 t as (select r, i, w, lead(w) over p as w2, lead(w, 2) over p as w3 from w window p as (partition by r order by i)),
 c as (select r, i, count(*) over (partition by r, w, w2, w3) as c from t where w3 is not null),
 rep as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from c where c > 1) group by r),
 ws as (select r, count(*) as n_words, sum(length(w)) as word_chars from w group by r),
 l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
 m as (select d.doc_id, d.source, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
       from d left join ws using (r) left join l using (r) left join rep using (r)),
 f as (select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repetitive, 10 * n_symbols > n_words as symbols,
        2 * n_dup_lines > n_lines as repeated_lines, word_chars < 2 * n_words or word_chars > 14 * n_words as odd_words from m),
 h as (select source as host, rule, count(*)::double as n, sum(x::int)::double as k from
        (select source, unnest(['short', 'repetitive', 'symbols', 'repeated_lines', 'odd_words']) as rule, unnest([short, repetitive, symbols, repeated_lines, odd_words]) as x from f where source is not null) group by all),
 s as (select rule, count(*)::double as h, sum(n) as nn, sum(k) as kk, sum(n * n) as n2, sum(k * k / n) as k2 from h group by rule),
 q as (select rule, kk / nn as mean, 1 / greatest(0.0001, least(0.2, case when kk > 0 and kk < nn and nn - n2 / nn - (h - 1) > 0
        then ((k2 - kk * kk / nn) / (kk / nn * (1 - kk / nn)) - (h - 1)) / (nn - n2 / nn - (h - 1)) else 0.2 end)) - 1 as strength from s),
 e as (select host, rule, (k + mean * strength) / (n + strength) as rate from h join q using (rule) union all select null, rule, mean from q),
 v as (select host, coalesce(host is not null and max(rate) > 0.5, false) as bad, list(rule) filter (where rate * 400 > 1 - rate) as strict from e group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short or repetitive) as base_failed, coalesce(bad, false) as host_bad,
 not (short or repetitive or coalesce(bad, false) or (symbols and coalesce(list_contains(strict, 'symbols'), false))
  or (repeated_lines and coalesce(list_contains(strict, 'repeated_lines'), false)) or (odd_words and coalesce(list_contains(strict, 'odd_words'), false))) as kept
from f left join v on f.source is not distinct from v.host
"""
